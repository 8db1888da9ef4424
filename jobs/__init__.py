"""Jobs to be run on their own: python -m jobs.word_intake, python -m jobs.law_report."""
