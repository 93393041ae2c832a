-- uses: statute referring resolving
SELECT doc_id, nth, title, document_number, CASE WHEN url IS NULL THEN 'cited_in_document' ELSE 'tavily' END AS source,
       'Tài liệu nhắc trực tiếp căn cứ này tại trang ' || page || CASE WHEN url IS NULL
         THEN '; chưa có nguồn web phù hợp trong allowlist để đối chiếu.'
         ELSE '; kết quả từ ' || host || ' được dùng để đối chiếu nội dung liên quan.' END AS reason,
       chunk_id AS citation_ids, url, host AS publisher, excerpt
FROM related
