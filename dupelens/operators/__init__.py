"""Operators over inventories: filters, duplicates, selection, totals, trees, pictures, sweeping, caches."""
