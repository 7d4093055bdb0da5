"""Column-expression builders (no jobs): recoding, flags, coercion, dates, labels, bins, custom orders."""

from cohortlens.functions.columns import (  # noqa: F401
    combo_label,
    conditional_value,
    count_tokens,
    custom_order,
    cut_edges,
    cut_labels,
    days_between,
    decimal_comma,
    equal_width_bin,
    flag_and,
    flag_contains,
    flag_equals,
    flag_in,
    map_values,
    multihot,
    replace_values,
    safe_ratio,
    strip_text,
    to_date_lenient,
    to_number,
    weighted_flag,
)
