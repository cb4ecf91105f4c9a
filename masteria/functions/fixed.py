"""Fixed values that results depend on."""

# Benchmarks that come first in the grid, in this order.
GRID_BENCHMARKS = ("MATH", "BBH", "GPQA", "IFEval", "MuSR")

# Known families; any other counts as "Other".
FAMILIES = ("Llama", "Qwen", "Mistral", "Gemma", "Phi", "Mixtral", "Other")

# Labels were cut upstream at this many characters.
LABEL_CUT = 50
# A cut label that ends in one of these is left as it is.
LABEL_ENDINGS = (".", "!", "?", ")", "…")

# Skills with fewer items than this are small clusters.
SMALL_CLUSTER = 3
# Largest size, in billions of parameters, that counts as a small model.
SMALL_MODEL_PARAMS = 13.0
# Bins of a skill's histogram over [0, 1].
HISTOGRAM_BINS = 16
# Buckets of a model's sorted profile.
SPARKLINE_BUCKETS = 25
# A distance of this much from the population mean has magnitude 1.
DELTA_FULL = 0.5
# Models in one comparison.
MAX_COMPARED = 3

# Characters beyond ASCII that count as white space in searches and labels.
WIDE_SPACE = ("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same in ASCII, besides the blank.
ASCII_SPACE = "\t\n\x0b\x0c\r"
WHITE_SPACE = ASCII_SPACE + " " + WIDE_SPACE
