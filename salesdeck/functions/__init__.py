"""Column expressions (all built-in, JVM-side, inside whole-stage codegen)."""
