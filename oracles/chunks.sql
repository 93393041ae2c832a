-- uses: statute
SELECT * FROM chunks
