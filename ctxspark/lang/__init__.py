"""Front end of the dialect: text to tokens to statements, rewrites, and SQL text."""
