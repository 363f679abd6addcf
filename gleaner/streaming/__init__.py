"""Extensions to streams of hits."""
