from tableprep.functions.datetime import datetime_parts
from tableprep.functions.numeric import clip, nan_to_null, round_half_even, safe_divide, to_numeric
from tableprep.functions.text import (as_text, clean_text, clean_text_array, clean_text_map, concat_text,
                                      text_length, unique_words, uppercase_ratio, word_count, word_tokens)

__all__ = ["datetime_parts", "clip", "nan_to_null", "round_half_even", "safe_divide", "to_numeric", "as_text",
           "clean_text", "clean_text_array", "clean_text_map", "concat_text", "text_length", "unique_words",
           "uppercase_ratio", "word_count", "word_tokens"]
