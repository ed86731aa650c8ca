"""The reference semantics are a one-shot batch release: a stream would spend the budget again with
every trigger, so there is deliberately no streaming operator here."""
