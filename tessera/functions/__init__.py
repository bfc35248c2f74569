"""Column functions: tokenizers, hashes, codecs and text windows."""
