"""Column functions: text helpers on the JVM, and the few parsers that need Python."""
