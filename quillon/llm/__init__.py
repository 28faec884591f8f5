"""Training-data operators: scoring, decontamination, packing, de-duplication, privacy, rollups, sharding, rules, chat."""
