"""Conversation memory: facts extracted by rule, contradictions invalidated, views ranked into a token budget."""
