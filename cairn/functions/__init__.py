"""Column functions for keys."""

from cairn.functions.keys import composite_keys, distinct_values, fan_out, fresh, key_bytes, next_power_of_two, path_prefixes, row_text, text_of

__all__ = ["composite_keys", "distinct_values", "fan_out", "key_bytes", "next_power_of_two", "path_prefixes", "row_text", "text_of"]
