"""Grammars, parser tables and lexers that tell whether a source file parses."""
