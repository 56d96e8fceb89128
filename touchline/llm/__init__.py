"""Training-data operators: mixing, token counts, near duplicates, document
fingerprints, byte-level BPE, pseudo-likelihood scoring, exact top-k search,
chat formatting, page extraction and language ID.  Nothing else in the
library imports this subpackage."""
