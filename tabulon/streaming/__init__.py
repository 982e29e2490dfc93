"""No stream operators: measures are computed over tables as they are when a query begins. New files reach a table by sources.lake."""
