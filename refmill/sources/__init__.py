"""Readers and writers: DOCX, text, PDF tokens, catalogues, exports."""
