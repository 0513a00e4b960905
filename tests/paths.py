"""Where the driver's tables lie."""

SF001 = "/root/testdata/sf0.001"
