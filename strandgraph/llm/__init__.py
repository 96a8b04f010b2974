"""Operators of a training-data pipeline: archives, rules, shards, near copies, repeats, URLs,
licences, tokens, benchmark leaks and id files. Nothing outside this subpackage imports it."""
