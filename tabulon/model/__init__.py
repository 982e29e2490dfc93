"""The semantic model: tables, relationships, measures, date tables."""
