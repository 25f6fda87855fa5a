from costlens.functions.columns import (  # noqa: F401
    count_le,
    count_lt,
    decide,
    default_grid,
    epoch_micros,
    lex_less_equal,
    portable_hash,
    portable_hash_sql,
    round6,
    safe_div,
)
