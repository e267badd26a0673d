"""Plans made of several steps: cutting points, pipelines, programs, rule mining."""
