"""Pure Python forms of the order-dependent operators: one block of text in, one result out. No Spark here."""
