"""Plans: the staged run over dumps, its command line, and the queries of the driver's contract."""
