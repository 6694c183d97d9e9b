"""Readers: delimited tables, file listings, waveforms, predictions."""
