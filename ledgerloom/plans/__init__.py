"""From rule text to relations: parsers, linear forms and Column expressions."""
