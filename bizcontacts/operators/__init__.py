"""DataFrame -> DataFrame building blocks; lazy, no driver-side loops over rows."""
