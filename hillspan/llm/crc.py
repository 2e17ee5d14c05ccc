"""CRC-32 of a number's decimals in DuckDB's SQL, which has no function for it."""

from __future__ import annotations

#: A table crc of one row: t, a list of the remainders of all bytes.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), n) AS v FROM (SELECT unnest(range(256)) AS n)))"
#: The unsigned checksum of the column {0}; crc must be among the tables.
CRC_SQL = "xor(4294967295, list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295))"
