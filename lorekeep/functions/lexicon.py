"""Word lists and thresholds that results depend on."""

from __future__ import annotations

# Fixed values; results must not depend on their order.
NEGATORS = [
    "no", "not", "never", "none", "cannot", "cant", "wont", "isnt", "arent", "doesnt", "dont", "didnt", "hasnt", "havent", "wasnt", "werent", "without",
    "lacks", "lacking", "absent", "denies", "denied", "refuses", "refused", "unable", "neither", "nor",
]
ANTONYMS = [
    ("increase", "decrease"), ("increases", "decreases"), ("increasing", "decreasing"), ("rising", "falling"), ("rose", "fell"), ("grew", "shrank"), ("growth", "decline"),
    ("above", "below"), ("higher", "lower"), ("more", "less"), ("required", "optional"), ("mandatory", "voluntary"), ("allowed", "forbidden"), ("permitted", "prohibited"),
    ("approved", "rejected"), ("accepted", "declined"), ("open", "closed"), ("opened", "closed"), ("active", "inactive"), ("available", "unavailable"), ("reachable", "unreachable"),
    ("centralized", "decentralized"), ("centralised", "decentralised"), ("expanding", "contracting"), ("renewed", "cancelled"), ("renewed", "canceled"), ("gained", "lost"),
    ("won", "lost"), ("started", "stopped"), ("began", "ended"),
]
CLAIM_STOP_WORDS = [
    "the", "a", "an", "of", "for", "to", "in", "on", "at", "by", "is", "are", "was", "were", "be", "been", "and", "or", "but", "with", "that", "this",
    "it", "its", "as", "from", "they", "their", "we", "our", "has", "have",
]
OVERLAP_FLOOR = 0.35
GAP_SLUG = r"^[a-z][a-z0-9]*(?:-[a-z0-9]+){1,5}$"
NON_NAMING_SLUGS = [
    "no-tag", "no-tag-for-this", "no-match", "not-applicable", "not-sure", "unknown-gap", "other-gap", "misc-gap", "to-be-decided", "to-do", "needs-review",
    "needs-a-tag", "new-tag-needed", "missing-tag", "no-category", "uncategorised", "uncategorized", "general-gap", "misc-other",
]
SLUG_FILLER = ["the", "a", "an", "of", "for", "this", "that", "thing", "stuff", "item", "gap", "new", "other", "misc", "general", "various"]
PROMOTION_FLOOR = 2
SIMILARITY_FLOOR = 0.75
LEAST_KEY_CHARS, LEAST_KEY_WORDS, LEAST_KEY_ENTROPY, BLOCK_CHARS = 6, 2, 1.5, 4
GENESIS = "0" * 64
CONTROL_FIELDS = ("supersede", "protected")
RESERVED_FIELDS = ("contradicts", "protected", "supersede", "unmapped_gap")
VERDICTS = ("ALLOW", "REQUIRE_APPROVAL", "BLOCK", "HALT")
ALLOW, REQUIRE_APPROVAL, BLOCK, HALT = range(4)
RUN = "__run__"
