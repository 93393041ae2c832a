-- uses: statute excerpts
SELECT * FROM cited
