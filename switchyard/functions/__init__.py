"""Column-level helpers (all built-in Spark expressions, codegen friendly)."""

from switchyard.functions.columns import (  # noqa: F401
    NULL_TOKENS, TIMESTAMP_FORMATS, coalesce_false, coalesce_true, differs, minutes_between,
    null_tokens_to_null, parse_timestamp, ratio, strip_ws, shift_minutes,
)
from switchyard.functions.text import (  # noqa: F401
    TOKEN_PATTERN, char_ngrams, fold_accents, word_ngrams, word_tokens,
    collapse_ws,
)
