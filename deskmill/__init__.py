"""deskmill: document and support-ticket analytics on Spark DataFrames."""
