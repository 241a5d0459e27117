"""DataFrame operators: windows, indicators, alignment, profiles, checks, forecasts."""
