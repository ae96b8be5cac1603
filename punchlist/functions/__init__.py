"""Column expressions: keys, dates, texts. None of them needs Python on the executors."""
