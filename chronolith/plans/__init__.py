"""Named queries over the canonical tables, each with its ANSI SQL counterpart where SQL can express it."""
