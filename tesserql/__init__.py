"""tesserql: MySQL-flavoured relational operators, expressions and sharding as Spark plans."""
