"""Sources and sinks: tables, nested documents, lines, databases, and outputs that change only where content does."""
