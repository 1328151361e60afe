"""The stateless parts over streams."""
