"""tactus: beat-grid, waveform and catalog analytics as Spark DataFrame operators."""
