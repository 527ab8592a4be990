from . import formats, json_text, patterns, scalar, texts, times, vectors  # noqa: F401  each adds its functions to scalar.FUNCTIONS
