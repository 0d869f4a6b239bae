"""Operators for preparing training text: tokens, quality, languages, duplicates, search, personal data, packing, pages, chats."""
