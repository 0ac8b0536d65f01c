"""Source tables: (corpus_id, source_pos, source_id, source_index, text, base_doc_offset, full_text, metadata)."""
