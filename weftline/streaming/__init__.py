"""The stateful parts on Structured Streaming: rate limits, rules with a lifetime, rolling rates, duplicates over time, batched sinks."""
