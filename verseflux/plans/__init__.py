"""End-to-end plans: text collection -> scored documents, waveforms -> features, both ->
correlation report."""
