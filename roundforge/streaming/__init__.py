"""Extensions on event streams; the batch queries use the same expressions."""
