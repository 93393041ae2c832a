SELECT doc_id, nfc_normalize(replace(text, chr(233), 'e' || chr(769))) AS text FROM documents
