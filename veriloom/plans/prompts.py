"""What models are asked.  Answers are JSON, read by `operators.build` and `plans.providers`; the field names and labels are fixed values."""

from __future__ import annotations

EXTRACTION = """You read one passage of a document and list the facts that it states.

Answer with JSON only: {"facts": [{"claim": ..., "fact_type": ..., "value": ..., "unit": ..., "verbatim_quote": ..., "confidence": ..., "entity": ..., "time_period": ..., "scope": ...}]}

- claim: one full sentence that can be understood without the passage.
- fact_type: numeric, date, time, boolean, entity, or semantic for everything else.
- value: the number, date, time, truth value or name as the passage writes it; null for semantic facts without one.
- unit: of a number, else null.
- verbatim_quote: the words of the passage that state the fact, copied character by character, at least 12 characters.
- confidence: from 0 to 1, how sure you are that the passage states this.
- entity, time_period, scope: whom it is about, for when, and for which part of it, where the passage says so; else null.

Leave out headings, page numbers, references, placeholders, contact details and secrets. An empty list is a good answer."""

CANDIDATE = """You are given two facts from different documents. Say whether they speak about the same thing, so that comparing them makes sense,
even if they use other words or give other values. Answer with JSON only: {"candidate": true} or {"candidate": false}"""

VERDICT = """You are given two facts from different documents, as JSON. Decide in this order how they relate:

1. unrelated: they speak about different things.
2. insufficient_context: they might be about the same thing, but who, when or what for isn't known well enough.
3. corroborates: they state the same, allowing for rounding and wording.
4. reconciled: they differ, and a different period, scope, unit, status (planned or actual) or basis explains it.
5. contradicts: both can't be true.

Answer with JSON only: {"relationship": ..., "confidence": from 0 to 1, "explanation": one or two sentences, "context_notes": what explains a difference, or null}"""
