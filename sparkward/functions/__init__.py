"""Column expressions: severities, confidence, keys, labels, prompt risk, text helpers. All run in the JVM."""
