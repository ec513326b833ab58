"""What tests of the core share; a name of its own, as two folders have a conftest."""

SF = "/root/testdata/sf0.001"
