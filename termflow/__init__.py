"""termflow: futures-research tables as Spark jobs over long (asset, date) panels."""
