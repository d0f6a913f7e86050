"""Notice analytics on Spark: tables of pages, words, notices and corrections in, tables out."""
