"""Where bars come from: tables, files, a generator; cleaning and validation; small stores."""
