"""Quality control of digitised audiovisual archives, and training-data operators, on Spark."""
