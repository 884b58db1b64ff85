"""Document trees as flat node tables on Spark."""
