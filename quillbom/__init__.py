"""Supply-chain and cryptography inventories as Spark DataFrame transformations."""
