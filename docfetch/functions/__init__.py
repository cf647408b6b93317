from docfetch.functions.columns import (  # noqa: F401
    account_rules,
    base_name,
    catalog_rules,
    decode_results,
    duration_text,
    encode_results,
    has_pdf_suffix,
    last_dot_piece,
    path_extension,
    seconds_between,
    stored_name,
)
