"""Models of the detection service: autoencoders, isolation forest and the scoring pass."""
