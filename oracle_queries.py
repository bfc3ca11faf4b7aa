"""DuckDB statements that compute the registered queries independently of the package."""

from __future__ import annotations

_BASES = (
    "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), "
    "'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN')"
)


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_REF = f"""
ref AS (SELECT * FROM (SELECT doc_id AS seq_id, {_BASES} AS seq FROM documents)
        WHERE seq IS NOT NULL)"""


def _reads(n: int) -> str:
    return f"""
items AS (SELECT item_id, {_BASES} AS seq FROM benchmark),
reads AS (SELECT item_id * 1048576 + t AS read_id,
                 substr(seq, CAST(least(t * {n}, length(seq) - {n}) + 1 AS BIGINT), {n}) AS seq
          FROM items, unnest(range(0, (length(seq) + {n - 1}) // {n})) u(t) WHERE length(seq) >= {n})"""


_READS = _reads(36)

_STRANDS = f"""
usable AS (SELECT * FROM reads WHERE length(seq) - length(replace(seq, 'N', '')) <= 3),
strands AS (SELECT read_id, false AS is_rc, seq AS q FROM usable
            UNION ALL SELECT read_id, true, {_rc('seq')} FROM usable)"""

_TILES = """
tiles AS (SELECT read_id, is_rc, q, pos, substr(q, CAST(pos + 1 AS BIGINT), 9) AS seed
          FROM strands, unnest(range(0, 28, 9)) u(pos)
          WHERE NOT contains(substr(q, CAST(pos + 1 AS BIGINT), 9), 'N'))"""

_SEEDS = """
seeds AS (SELECT seq_id AS ref_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 9) AS seed, seq
          FROM ref, unnest(range(0, length(seq) - 8)) u(pos)
          WHERE NOT contains(substr(seq, CAST(pos + 1 AS BIGINT), 9), 'N'))"""

_WINDOWS = """
windows AS (SELECT seq_id AS ref_id, p, substr(seq, CAST(p + 1 AS BIGINT), 36) AS w
            FROM ref, unnest(range(0, length(seq) - 35)) u(p))"""

_TILE_HITS = "tile_hits AS (" + " UNION ALL ".join(
    f"""
SELECT read_id, is_rc, ref_id, p, CAST(hamming(q, w) AS INTEGER) AS differences, q, w
FROM strands JOIN windows ON substr(q, {9 * j + 1}, 9) = substr(w, {9 * j + 1}, 9)
WHERE NOT contains(substr(q, {9 * j + 1}, 9), 'N') AND hamming(q, w) <= 3"""
    for j in range(4)
) + ")"

_HITS = f"""{_REF},{_READS},{_STRANDS},{_WINDOWS},{_TILE_HITS},
places AS (SELECT DISTINCT read_id, ref_id, p AS ref_start, p + 36 AS ref_end, differences, is_rc, q, w
           FROM tile_hits),
hits AS (SELECT read_id, ref_id, ref_start, ref_end, differences, is_rc FROM places)"""



def _long_hits(k: int, n: int) -> str:
    """All places of reads of n bases within k substitutions, through any clean tile."""
    s = n // (k + 1)
    tile = lambda of, j: f"substr({of}, {s * j + 1}, {s})"
    found = " UNION ".join(
        f"""SELECT read_id, ref_id, p AS ref_start, p + {n} AS ref_end,
                   CAST(hamming(q, w) AS INTEGER) AS differences, is_rc
            FROM strands JOIN windows ON {tile('q', j)} = {tile('w', j)}
            WHERE NOT contains({tile('q', j)}, 'N') AND hamming(q, w) <= {k}"""
        for j in range(n // s)
    )
    return f"""WITH {_REF},{_reads(n)},
usable AS (SELECT * FROM reads WHERE length(seq) - length(replace(seq, 'N', '')) <= {k}),
strands AS (SELECT read_id, false AS is_rc, seq AS q FROM usable
            UNION ALL SELECT read_id, true, {_rc('seq')} FROM usable),
windows AS (SELECT seq_id AS ref_id, p, substr(seq, CAST(p + 1 AS BIGINT), {n}) AS w
            FROM ref, unnest(range(0, length(seq) - {n - 1})) u(p))
{found}"""


_LEVELS = f"""{_HITS},
ranked AS (SELECT *, min(differences) OVER (PARTITION BY read_id) AS least FROM hits),
best AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS n_best,
                row_number() OVER (PARTITION BY read_id
                                   ORDER BY ref_id, ref_start, ref_end, is_rc) AS rn
         FROM ranked WHERE differences = least)"""


def _extension(text: str, pattern: str) -> str:
    """List minimum of (distance, prefix length) over the prefixes that can be within 3 edits."""
    return f"""list_min(list_filter(list_transform(
        range(greatest(length({pattern}) - 3, 0), least(length({pattern}) + 3, length({text})) + 1),
        lambda j: {{'d': levenshtein({pattern}, substr({text}, 1, j)), 'j': j}}),
        lambda s: s.d <= 3))"""


_FLANKED = f"""{_REF},{_READS},{_STRANDS},{_TILES},{_SEEDS},
flanked AS (
  SELECT read_id, is_rc, ref_id, s.pos AS pos, t.pos AS tile_start, seed,
    reverse(substr(seq, CAST(greatest(s.pos - 30, 0) + 1 AS BIGINT), CAST(least(s.pos, 30) AS BIGINT))) AS tl,
    substr(seq, CAST(s.pos + 10 AS BIGINT), 30) AS tr,
    reverse(substr(q, 1, CAST(t.pos AS BIGINT))) AS ql, substr(q, CAST(t.pos + 10 AS BIGINT)) AS qr
  FROM seeds s JOIN tiles t USING (seed)),
extended AS (SELECT *, {_extension('tl', 'ql')} AS l, {_extension('tr', 'qr')} AS r FROM flanked)"""

def _trace_step(source: str) -> str:
    """One edit more: shared bases are passed over, then the first operation that fits is taken."""
    return f"""SELECT read_id, ref_id, ref_start, ref_end, is_rc, total,
      CASE WHEN op IS NULL THEN r WHEN op = 1 THEN r1 ELSE substr(r1, 2) END AS r,
      CASE WHEN op IS NULL THEN w WHEN op = -1 THEN w1 ELSE substr(w1, 2) END AS w,
      CASE WHEN op IS NULL THEN left_over ELSE left_over - 1 END AS left_over,
      CASE WHEN op IS NULL THEN dist ELSE list_append(dist, same) END AS dist,
      CASE WHEN op IS NULL THEN what ELSE list_append(what, op) END AS what
    FROM (
      SELECT *, CASE WHEN left_over = 0 THEN NULL
        WHEN length(r1) > 0 AND length(w1) > 0 AND levenshtein(substr(r1, 2), substr(w1, 2)) = left_over - 1 THEN 0
        WHEN length(r1) > 0 AND levenshtein(substr(r1, 2), w1) = left_over - 1 THEN -1 ELSE 1 END AS op
      FROM (SELECT *, substr(r, same + 1) AS r1, substr(w, same + 1) AS w1
            FROM (SELECT *, CAST(coalesce(list_position(list_transform(range(1, least(length(r), length(w)) + 1),
                    lambda i: substr(r, i, 1) = substr(w, i, 1)), false) - 1, least(length(r), length(w))) AS BIGINT) AS same
                  FROM {source})))"""


_DIGEST = "CAST(sum(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)) AS BIGINT)"

_HIT_COLUMNS = "read_id, ref_id, ref_start, ref_end, differences, is_rc"
_ALL_HITS = f"WITH {_HITS} SELECT {_HIT_COLUMNS} FROM hits"


def oracle_sql() -> dict[str, str]:
    return {
        "align_exact": _long_hits(0, 36),
        "align_stored_index": f"""WITH {_HITS} SELECT {_HIT_COLUMNS},
            CASE WHEN (read_id // 1048576) % 2 = 1 THEN 'odd' ELSE 'even' END AS read_set FROM hits""",
        "align_long_reads": _long_hits(3, 76),
        "normalize_bases": """
            SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                                          '[^ACGT]', 'N', 'g') AS seq FROM documents""",
        "reverse_complement": f"WITH {_REF} SELECT seq_id, {_rc('seq')} AS seq FROM ref",
        "expand_strands": f"""
            WITH {_READS} SELECT read_id, false AS is_rc, seq FROM reads
            UNION ALL SELECT read_id, true, {_rc('seq')} FROM reads""",
        "assert_read_length": f"""
            WITH {_READS} SELECT item_id AS read_id, seq FROM items
            WHERE length(seq) BETWEEN 150 AND 200""",
        "filter_ambiguous_reads": f"""
            WITH {_READS} SELECT read_id, seq FROM reads
            WHERE length(seq) - length(replace(seq, 'N', '')) <= 3""",
        "chunk_sequences": f"""
            WITH {_REF},
            cut AS (SELECT seq_id, seq AS whole, length(seq) AS n, i,
                           greatest(1, CAST(ceil((length(seq) - 1024) / 1024.0) AS BIGINT)) AS chunks
                    FROM ref, unnest(range(0, greatest(1, CAST(ceil((length(seq) - 1024) / 1024.0) AS BIGINT)))) u(i)),
            pieces AS (SELECT seq_id, i * 1024 AS "offset", i = chunks - 1 AS is_last,
                              substr(whole, CAST(i * 1024 + 1 AS BIGINT), 2048) AS seq FROM cut)
            SELECT *, "offset" + CASE WHEN "offset" = 0 THEN 0 ELSE 986 END AS own_start,
                   "offset" + length(seq) - 8 - CASE WHEN is_last THEN 0 ELSE 30 END AS own_end
            FROM pieces""",
        "reference_seeds": f"""
            WITH {_REF},{_SEEDS}
            SELECT seed, count(*) AS places, min(pos) AS first_pos,
                   CAST(sum(pos) AS BIGINT) AS pos_sum
            FROM seeds GROUP BY seed""",
        "reference_seed_flanks": f"""
            WITH {_REF},{_SEEDS},
            f AS (SELECT ref_id, pos, seed,
                    reverse(substr(seq, CAST(greatest(pos - 30, 0) + 1 AS BIGINT), CAST(least(pos, 30) AS BIGINT))) AS l,
                    substr(seq, CAST(pos + 10 AS BIGINT), 30) AS r FROM seeds)
            SELECT ref_id, count(*) AS places, CAST(sum(length(l)) AS BIGINT) AS left_bases,
                   CAST(sum(length(r)) AS BIGINT) AS right_bases,
                   {_DIGEST.format("l || '-' || seed || '-' || r")} AS digest
            FROM f GROUP BY ref_id""",
        "read_seeds": f"""
            WITH {_READS},{_STRANDS},{_TILES}
            SELECT read_id, is_rc, CAST(pos AS INTEGER) AS pos, seed,
                   reverse(substr(q, 1, CAST(pos AS BIGINT))) AS left_flank,
                   substr(q, CAST(pos + 10 AS BIGINT)) AS right_flank
            FROM tiles""",
        "pack_kmer": f"""
            WITH {_REF},{_SEEDS}, kmers AS (SELECT DISTINCT seed FROM seeds)
            SELECT seed, CAST({' + '.join(
                f"(strpos('ACGT', substr(seed, {i + 1}, 1)) - 1) * {4 ** (8 - i)}" for i in range(9)
            )} AS BIGINT) AS packed FROM kmers""",
        "homopolymer_seeds": f"""
            WITH {_REF},{_SEEDS}
            SELECT ref_id, seed, count(*) AS places FROM seeds
            WHERE seed = repeat(substr(seed, 1, 1), 9) GROUP BY ref_id, seed""",
        "salted_reference_seeds": f"""
            WITH {_REF},{_SEEDS},
            salted AS (SELECT seed, pos, unnest(CASE WHEN seed = repeat(substr(seed, 1, 1), 9)
                                                THEN range(0, 16) ELSE [0::BIGINT] END) AS salt
                       FROM seeds)
            SELECT seed, CAST(salt AS INTEGER) AS salt, count(*) AS places,
                   CAST(sum(pos) AS BIGINT) AS pos_sum
            FROM salted GROUP BY ALL""",
        "salted_read_seeds": f"""
            WITH {_READS},{_STRANDS},{_TILES}
            SELECT read_id, is_rc, CAST(pos AS INTEGER) AS pos, seed,
                   CAST(CASE WHEN seed = repeat(substr(seed, 1, 1), 9)
                        THEN ((read_id % 16) + 16) % 16 ELSE 0 END AS INTEGER) AS salt
            FROM tiles""",
        "seed_candidates_per_read": f"""
            WITH {_REF},{_READS},{_STRANDS},{_TILES},{_SEEDS}
            SELECT read_id, is_rc, count(*) AS candidates
            FROM tiles JOIN seeds USING (seed) GROUP BY read_id, is_rc""",
        "salted_seed_join": f"""
            WITH {_REF},{_READS},{_STRANDS},{_TILES},{_SEEDS}
            SELECT read_id, is_rc, CAST(t.pos AS INTEGER) AS tile_start, count(*) AS candidates,
                   CAST(sum(s.pos) AS BIGINT) AS pos_sum
            FROM tiles t JOIN seeds s USING (seed) GROUP BY read_id, is_rc, t.pos""",
        "k_mismatch_verify": f"""
            WITH {_HITS} SELECT read_id, is_rc, differences, count(*) AS clean_tiles
            FROM tile_hits GROUP BY read_id, is_rc, differences""",
        "align_all": _ALL_HITS,
        "align_all_shuffled": _ALL_HITS,
        "align_all_refined": _ALL_HITS,
        "align_all_chunked": _ALL_HITS,
        "align_mixed_chunks": _ALL_HITS,
        "best_hit": f"""
            WITH {_LEVELS} SELECT read_id, differences, n_best, ref_id, ref_start, ref_end, is_rc
            FROM best WHERE rn = 1""",
        "align_unique": f"""
            WITH {_LEVELS} SELECT {_HIT_COLUMNS} FROM best WHERE n_best = 1""",
        "ambiguous_reads": f"""
            WITH {_LEVELS} SELECT read_id, differences, n_best FROM best WHERE n_best > 1 AND rn = 1""",
        "alignment_count": f"""
            WITH {_LEVELS} SELECT count(*) AS alignments FROM best WHERE n_best = 1""",
        "alignment_summary": f"""
            WITH {_HITS} SELECT differences, is_rc, count(*) AS alignments FROM hits
            GROUP BY differences, is_rc""",
        "mismatch_positions": f"""
            WITH {_HITS},
            found AS (SELECT read_id, ref_id, ref_start, is_rc,
                        list_filter(range(0, 36), lambda i: q[i + 1] <> w[i + 1]) AS found_at FROM places)
            SELECT read_id, ref_id, ref_start, is_rc, array_to_string(found_at, ',') AS positions,
                   array_to_string(list_transform(range(0, len(found_at) + 1), lambda i:
                     CASE WHEN i = len(found_at) THEN 36 ELSE found_at[i + 1] END
                     - CASE WHEN i = 0 THEN 0 ELSE found_at[i] END), ',') AS runs
            FROM found""",
        "gapped_edit_arrays": f"""
            WITH {_FLANKED},
            t0 AS (SELECT DISTINCT read_id, ref_id, pos - l.j AS ref_start, pos + 9 + r.j AS ref_end, is_rc,
                          reverse(substr(tl, 1, l.j)) || seed || substr(tr, 1, r.j) AS r, reverse(ql) || seed || qr AS w
                   FROM extended WHERE l.d + r.d <= 3),
            s0 AS (SELECT *, length(w) AS total, levenshtein(r, w) AS left_over, CAST([] AS BIGINT[]) AS dist,
                          CAST([] AS INTEGER[]) AS what FROM t0),
            s1 AS ({_trace_step('s0')}), s2 AS ({_trace_step('s1')}), s3 AS ({_trace_step('s2')})
            SELECT read_id, ref_id, ref_start, ref_end, is_rc,
                   array_to_string(list_append(dist, length(w)), ',') AS dist,
                   array_to_string(list_append(what, 2), ',') AS what FROM s3""",
        "overlap_mismatch": f"""
            WITH {_READS},
            pairs AS (SELECT a.item_id, a.seq AS t, b.seq AS p,
                             least(length(a.seq), length(b.seq)) AS n
                      FROM items a JOIN items b ON b.item_id = a.item_id + 1),
            counted AS (SELECT *, hamming(substr(t, 1, n), substr(p, 1, n)) AS d FROM pairs)
            SELECT item_id, CAST(n AS INTEGER) AS aligned_len, CAST(d AS INTEGER) AS differences
            FROM counted WHERE d <= 120""",
        "k_difference_extend": f"""
            WITH {_FLANKED}
            SELECT read_id, is_rc, ref_id, pos, CAST(tile_start AS INTEGER) AS tile_start,
                   CAST(r.d AS INTEGER) AS differences, CAST(r.j AS INTEGER) AS aligned_len
            FROM extended WHERE r IS NOT NULL""",
        "align_all_gapped": f"""
            WITH {_FLANKED}
            SELECT read_id, ref_id, pos - l.j AS ref_start, pos + 9 + r.j AS ref_end,
                   CAST(min(l.d + r.d) AS INTEGER) AS differences, is_rc
            FROM extended WHERE l.d + r.d <= 3 GROUP BY ALL""",
        "gapped_edits": f"""
            WITH {_FLANKED},
            found AS (SELECT DISTINCT read_id, ref_id, pos - l.j AS ref_start, pos + 9 + r.j AS ref_end, is_rc,
                             reverse(substr(tl, 1, l.j)) || seed || substr(tr, 1, r.j) AS piece,
                             reverse(ql) || seed || qr AS seq
                      FROM extended WHERE l.d + r.d <= 3)
            SELECT read_id, ref_id, ref_start, ref_end, is_rc, CAST(levenshtein(piece, seq) AS INTEGER) AS n_edits,
                   CAST(length(piece) - length(seq) AS INTEGER) AS longer_by, seq
            FROM found""",
        "alignments_text": f"""
            WITH {_HITS}
            SELECT concat_ws(chr(9), ref_id, ref_start, ref_end, read_id, differences,
                             CASE WHEN is_rc THEN '-' ELSE '+' END) AS value FROM hits""",
        "alignments_text_roundtrip": f"""
            WITH {_HITS} SELECT ref_id, ref_start, ref_end, differences, is_rc FROM hits""",
        "encode_packed": f"""
            WITH {_REF} SELECT seq_id, '0100000000' || translate(seq, 'ACGTN', '01248')
                   || CASE WHEN length(seq) % 2 = 1 THEN 'F' ELSE '' END AS value FROM ref""",
        "packed_roundtrip": f"""
            WITH {_REF} SELECT seq_id, CAST(0 AS BIGINT) AS "offset", true AS is_last, seq FROM ref""",
        "packed_files_roundtrip": f"""
            WITH {_REF} SELECT seq_id, CAST(0 AS BIGINT) AS "offset", true AS is_last, seq FROM ref""",
        "alignments_packed": f"""
            WITH {_HITS} SELECT read_id, CASE WHEN is_rc THEN '01' ELSE '00' END
                   || lpad(upper(to_hex(ref_id)), 8, '0') || lpad(upper(to_hex(ref_start)), 8, '0')
                   || lpad(upper(to_hex(ref_end)), 8, '0') || lpad(upper(to_hex(differences)), 8, '0')
                   AS value FROM hits""",
        "alignments_packed_roundtrip": _ALL_HITS,
        "sequence_files_roundtrip": f"""
            WITH {_REF} SELECT seq_id, CAST(0 AS BIGINT) AS "offset", true AS is_last, seq FROM ref""",
        "alignment_files_roundtrip": _ALL_HITS,
        "alignments_write_read": _ALL_HITS,
        "complete_job": f"""
            WITH {_LEVELS}
            SELECT 'alignments' AS kind, {_HIT_COLUMNS}, count(*) OVER () AS written FROM hits
            UNION ALL
            SELECT 'unambiguous', {_HIT_COLUMNS}, count(*) OVER () FROM best WHERE n_best = 1""",
    }
