"""DuckDB SQL oracle: the adapter views and one independent SQL per query.

The SQL is written from the operator semantics, not from the Spark code: it
uses the reference's own regular expressions (RE2 runs them in linear time),
``string_agg ... ORDER BY`` for ordered concat and plain window functions.
"""

from __future__ import annotations

from casepipe.functions.text import CITATION_PATTERN_REFERENCE, FACT_PATTERN_REFERENCE

NUM_RE = r"^\d+\."
PROMPT_HEAD = "Label the paragraph below with 1 if it states a fact of the case, else 0.\nParagraph: "
PROMPT_TAIL = "\nAnswer:"
TRUNCATE_CHARS = 2000  # of truncate_text, whose feature the cut is

# name -> (dependencies, SELECT body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "paras": (
        (),
        r"""
SELECT 'xml_page_' || (doc_id % 10 + 1) || '/doc_' || doc_id || '.xml' AS file_name,
       doc_id,
       CAST(pos AS INTEGER) AS pos,
       CASE pos % 7
         WHEN 0 THEN (pos + 1) || '. ' || p
         WHEN 1 THEN p || ' see [' || (2000 + doc_id % 24) || '] EWHC ' || (100 + doc_id) || ' (Admin)'
         WHEN 2 THEN p || ' under s.' || (1 + doc_id % 300) || ' of the Act'
         WHEN 3 THEN 'a-b-c-d ' || p
         WHEN 4 THEN chr(9)
         WHEN 5 THEN '***'
         ELSE p END AS paragraph
FROM (SELECT doc_id, unnest(arr) AS p, generate_subscripts(arr, 1) - 1 AS pos
      FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents))
""",
    ),
    "kept": (
        ("paras",),
        r"""
SELECT * FROM paras
WHERE paragraph IS NOT NULL
  AND length(paragraph) - length(replace(paragraph, '-', '')) <= 2
  AND regexp_matches(paragraph, '\S')
  AND regexp_matches(paragraph, '[\p{L}\p{N}]')
""",
    ),
    "ij_labels": (
        ("kept",),
        r"""
SELECT file_name, doc_id, paragraph, pos, 0 AS dup,
       CAST(CASE WHEN (doc_id + pos) % 17 = 0 THEN NULL WHEN pos < 3 THEN 1 ELSE 0 END AS INTEGER) AS introduction,
       CAST(CASE WHEN (doc_id + pos) % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS judgment
FROM kept
UNION ALL
SELECT file_name, doc_id, paragraph, pos, 1 AS dup,
       CAST(CASE WHEN (doc_id + pos) % 17 = 0 THEN NULL WHEN pos < 3 THEN 1 ELSE 0 END AS INTEGER),
       CAST(CASE WHEN (doc_id + pos) % 11 = 0 THEN 0 ELSE 1 END AS INTEGER)
FROM kept WHERE (doc_id + pos) % 13 = 0
""",
    ),
    "ij_part": (("ij_labels",), "SELECT * FROM ij_labels WHERE (doc_id + pos) % 3 <> 0"),
    "citation_labels": (
        ("kept",),
        r"""
SELECT file_name, doc_id, paragraph, pos,
       CAST(CASE WHEN (doc_id + pos) % 19 = 0 THEN NULL WHEN pos % 7 = 1 THEN 1 ELSE 0 END AS INTEGER) AS citation
FROM kept
""",
    ),
    "citation_part": (("citation_labels",), "SELECT * FROM citation_labels WHERE (doc_id + pos) % 2 = 0"),
    "fact_labels": (
        ("kept",),
        r"""
SELECT file_name, doc_id, paragraph, pos, 0 AS dup,
       CASE (doc_id + pos) % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'Output: 1'
            WHEN 3 THEN 'yes' WHEN 4 THEN '10' ELSE NULL END AS fact
FROM kept
UNION ALL
SELECT file_name, doc_id, paragraph, pos, 1 AS dup, '0' AS fact
FROM kept WHERE (doc_id + pos) % 9 = 0
""",
    ),
    "fact_part": (("fact_labels",), "SELECT * FROM fact_labels WHERE (doc_id + pos) % 5 <> 1"),
    "header_paras": (
        ("paras",),
        r"""
SELECT file_name, doc_id, pos,
       CASE WHEN doc_id % 5 = 0 THEN chr(10) ELSE paragraph || chr(10) END AS paragraph
FROM paras WHERE NOT ends_with(paragraph, '.') AND pos % 7 NOT IN (4, 5) AND doc_id % 7 <> 3
""",
    ),
    "body_paras": (
        ("paras",),
        r"""
SELECT file_name, doc_id, pos,
       CASE WHEN doc_id % 3 = 0 AND pos = 6 THEN 'Hearing date: ' || paragraph
            WHEN doc_id % 3 <> 2 AND pos = 4 THEN 'JUDGMENT'
            ELSE paragraph END AS paragraph
FROM paras WHERE ends_with(paragraph, '.') OR pos % 7 IN (4, 5)
""",
    ),

    "numbered": (
        ("kept",),
        r"""
SELECT file_name, CAST(gid AS INTEGER) AS gid,
       regexp_replace(string_agg(paragraph, ' ' ORDER BY pos), '^\s+|\s+$', '', 'g') AS paragraph
FROM (SELECT *, sum(CASE WHEN regexp_matches(paragraph, '^\d+\.') THEN 1 ELSE 0 END)
                  OVER (PARTITION BY file_name ORDER BY pos) AS gid FROM kept)
GROUP BY file_name, gid
""",
    ),
    "several": (
        ("numbered",),
        r"""
SELECT file_name FROM numbered WHERE CAST(regexp_extract(file_name, 'doc_([0-9]+)', 1) AS BIGINT) % 3 <> 1
GROUP BY file_name HAVING count(*) > 1
""",
    ),
    "cons": (
        ("kept", "ij_part", "citation_part", "fact_part"),
        r"""
SELECT k.file_name, k.pos,
       'The paragraph number is ' || row_number() OVER (PARTITION BY k.file_name ORDER BY k.pos) AS paragraph_number,
       k.paragraph,
       CAST(coalesce(ij.introduction, 0) AS INTEGER) AS introduction,
       CAST(coalesce(fa.fact, 0) AS INTEGER) AS fact,
       CAST(coalesce(ci.citation, 0) AS INTEGER) AS citation,
       CAST(coalesce(ij.judgment, 0) AS INTEGER) AS judgment
FROM kept k
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, paragraph ORDER BY pos, dup) AS rn
                          FROM ij_part) WHERE rn = 1) ij
  ON k.file_name IS NOT DISTINCT FROM ij.file_name AND k.paragraph IS NOT DISTINCT FROM ij.paragraph
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, paragraph ORDER BY pos) AS rn
                          FROM citation_part) WHERE rn = 1) ci
  ON k.file_name IS NOT DISTINCT FROM ci.file_name AND k.paragraph IS NOT DISTINCT FROM ci.paragraph
LEFT JOIN (SELECT file_name, paragraph,
                  CASE WHEN fact LIKE '%0%' THEN 0 WHEN fact LIKE '%1%' THEN 1 END AS fact
           FROM (SELECT *, row_number() OVER (PARTITION BY file_name, paragraph ORDER BY pos, dup) AS rn
                 FROM fact_part) WHERE rn = 1) fa
  ON k.file_name IS NOT DISTINCT FROM fa.file_name AND k.paragraph IS NOT DISTINCT FROM fa.paragraph
""",
    ),
    "cover": (
        ("header_paras",),
        r"""
SELECT f.file_name, coalesce(c.cover_text, '') AS cover_text
FROM (SELECT DISTINCT file_name FROM header_paras) f
LEFT JOIN (SELECT file_name, string_agg(paragraph, '' ORDER BY pos) AS cover_text
           FROM header_paras
           WHERE paragraph IS NOT NULL
             AND length(paragraph) - length(replace(paragraph, '-', '')) <= 2
             AND regexp_matches(paragraph, '\S')
           GROUP BY file_name) c USING (file_name)
""",
    ),
    "prefix": (
        ("body_paras",),
        r"""
SELECT b.file_name, string_agg(b.paragraph, chr(10) ORDER BY b.pos) AS prefix_text
FROM body_paras b
JOIN (SELECT file_name,
             coalesce(min(CASE WHEN lower(paragraph) LIKE '%hearing date%' THEN pos END),
                      min(CASE WHEN lower(paragraph) LIKE '%judgment%' THEN pos END),
                      max(pos)) AS cut
      FROM body_paras GROUP BY file_name) c USING (file_name)
WHERE b.pos <= c.cut
GROUP BY b.file_name
""",
    ),
}


def _collect(names, out):
    for n in names:
        deps, _ = VIEWS[n]
        _collect(deps, out)
        if n not in out:
            out.append(n)
    return out


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order = _collect(names, [])
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    if stripped[:6].upper() != "SELECT":  # the body goes on with views of its own
        return f"WITH {ctes},\n{stripped}"
    return f"WITH {ctes}\n{body}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


CIT = q(CITATION_PATTERN_REFERENCE)
FACT = q(FACT_PATTERN_REFERENCE)
NUM = q(NUM_RE)


def _base_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    out["case_summary"] = with_views(
        f"""
SELECT file_name,
       CAST(count(*) AS BIGINT) AS n_paragraphs,
       CAST(count(DISTINCT gid) AS BIGINT) AS n_numbered,
       CAST(sum(CASE WHEN regexp_matches(paragraph, {CIT}) THEN 1 ELSE 0 END) AS BIGINT) AS n_citation,
       CAST(sum(CASE WHEN regexp_matches(paragraph, {FACT}) THEN 1 ELSE 0 END) AS BIGINT) AS n_fact,
       CAST(sum(length(paragraph)) AS BIGINT) AS n_chars
FROM (SELECT *, sum(CASE WHEN regexp_matches(paragraph, {NUM}) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY file_name ORDER BY pos) AS gid
      FROM kept)
GROUP BY file_name
""",
        "kept",
    )

    out["para_filter_main"] = with_views("SELECT file_name, pos, paragraph FROM kept", "kept")
    out["para_filter_cover"] = with_views(
        r"""SELECT file_name, pos, paragraph FROM paras
WHERE paragraph IS NOT NULL AND length(paragraph) - length(replace(paragraph, '-', '')) <= 2
  AND regexp_matches(paragraph, '\S')""",
        "paras",
    )
    out["citation_flag"] = with_views(
        f"SELECT file_name, pos, CAST(coalesce(regexp_matches(paragraph, {CIT}), false) AS INTEGER) AS citation FROM paras", "paras"
    )
    out["fact_flag"] = with_views(
        f"SELECT file_name, pos, CAST(coalesce(regexp_matches(paragraph, {FACT}), false) AS INTEGER) AS fact FROM paras", "paras"
    )
    out["starts_with_number"] = with_views(
        f"SELECT file_name, pos, CAST(coalesce(regexp_matches(paragraph, {NUM}), false) AS INTEGER) AS numbered FROM paras", "paras"
    )
    out["annotated_paragraphs"] = with_views(
        f"""SELECT file_name, pos, paragraph, CAST(0 AS INTEGER) AS introduction,
       CAST(regexp_matches(paragraph, {FACT}) AS INTEGER) AS fact,
       CAST(regexp_matches(paragraph, {CIT}) AS INTEGER) AS citation,
       CAST(0 AS INTEGER) AS judgment
FROM kept""",
        "kept",
    )
    out["path_parts"] = with_views(
        r"""SELECT file_name,
       regexp_extract(regexp_extract(file_name, '([^/\\]*)[/\\][^/\\]*$', 1), '([^_]*)$', 1) AS page,
       substr(regexp_extract(file_name, '([^/\\]*)$', 1), 1, greatest(length(regexp_extract(file_name, '([^/\\]*)$', 1)) - 4, 0)) AS case_name
FROM (SELECT DISTINCT file_name FROM paras)""",
        "paras",
    )
    out["paragraph_number"] = with_views(
        """SELECT file_name, pos,
       'The paragraph number is ' || row_number() OVER (PARTITION BY file_name ORDER BY pos) AS paragraph_number
FROM kept""",
        "kept",
    )
    out["model_text"] = with_views(
        """SELECT file_name, pos,
       'The paragraph number is ' || row_number() OVER (PARTITION BY file_name ORDER BY pos) || ' ' || paragraph AS model_text
FROM kept""",
        "kept",
    )
    out["truncate_text"] = with_views(f"SELECT file_name, pos, substr(paragraph, 1, {TRUNCATE_CHARS}) AS text FROM paras", "paras")
    out["render_prompts"] = with_views(
        f"SELECT file_name, pos, {q(PROMPT_HEAD)} || paragraph || {q(PROMPT_TAIL)} AS prompt FROM kept",
        "kept",
    )
    out["normalise_label"] = with_views(
        """SELECT file_name, pos, dup, fact,
       CAST(CASE WHEN fact LIKE '%0%' THEN 0 WHEN fact LIKE '%1%' THEN 1 END AS INTEGER) AS label
FROM fact_labels""",
        "fact_labels",
    )
    out["fill_zero"] = with_views(
        "SELECT file_name, pos, CAST(coalesce(citation, 0) AS INTEGER) AS citation FROM citation_labels", "citation_labels"
    )
    out["label_vectors"] = with_views(
        "SELECT file_name, pos, [introduction, fact, citation, judgment] AS labels FROM cons", "cons"
    )
    out["numbered_paragraphs"] = with_views("SELECT * FROM numbered", "numbered")
    out["doc_concat"] = with_views(
        "SELECT file_name, string_agg(paragraph, ' ' ORDER BY pos) AS text FROM kept GROUP BY file_name", "kept"
    )
    out["cover_text"] = with_views("SELECT * FROM cover", "cover")
    out["prefix_until_marker"] = with_views("SELECT * FROM prefix", "prefix")
    out["cover_fill"] = with_views(
        r"""SELECT c.file_name,
       CASE WHEN regexp_replace(c.cover_text, '^\s+|\s+$', '', 'g') = '' THEN coalesce(p.prefix_text, '')
            ELSE c.cover_text END AS cover_text
FROM cover c LEFT JOIN prefix p USING (file_name)""",
        "cover",
        "prefix",
    )
    out["value_counts"] = with_views(
        "SELECT fact, CAST(count(*) AS BIGINT) AS count FROM fact_labels GROUP BY fact", "fact_labels"
    )
    out["value_counts_nonnull"] = with_views(
        "SELECT fact, CAST(count(*) AS BIGINT) AS count FROM fact_labels WHERE fact IS NOT NULL GROUP BY fact", "fact_labels"
    )
    out["null_profile"] = with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM ij_labels"
            for c in ("file_name", "paragraph", "pos", "dup", "introduction", "judgment")
        ),
        "ij_labels",
    )
    out["label_totals"] = with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS label, CAST(coalesce(sum({c}), 0) AS BIGINT) AS total FROM cons"
            for c in ("introduction", "fact", "citation", "judgment")
        ),
        "cons",
    )
    out["paragraphs_per_file"] = with_views(
        "SELECT file_name, CAST(count(*) AS BIGINT) AS n_paragraphs FROM kept GROUP BY file_name", "kept"
    )
    out["single_paragraph_files"] = with_views(
        "SELECT file_name FROM numbered GROUP BY file_name HAVING count(*) = 1", "numbered"
    )
    out["corpus_shape"] = with_views(
        """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns,
       CAST(count(DISTINCT file_name) AS BIGINT) AS n_files FROM kept""",
        "kept",
    )
    out["missing_files"] = with_views(
        """SELECT DISTINCT file_name FROM paras p
WHERE doc_id % 50 IN (7, 8) OR NOT EXISTS (SELECT 1 FROM kept n WHERE n.file_name = p.file_name AND n.pos >= 2)""",
        "paras",
        "kept",
    )
    out["sorted_paragraphs"] = with_views("SELECT file_name, pos, paragraph FROM kept", "kept")
    out["head_rows"] = with_views("SELECT file_name, pos, paragraph FROM kept ORDER BY file_name, pos LIMIT 5", "kept")
    out["distinct_files"] = with_views("SELECT file_name, min(pos) AS first_pos FROM kept GROUP BY file_name", "kept")
    out["dedup_first"] = with_views(
        """SELECT file_name, paragraph, pos, dup, fact FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name, paragraph ORDER BY pos, dup) AS rn FROM fact_labels)
WHERE rn = 1""",
        "fact_labels",
    )
    out["dedup_all"] = with_views("SELECT DISTINCT file_name, paragraph, fact FROM fact_labels", "fact_labels")
    out["union_by_name"] = with_views(
        """SELECT file_name, pos, citation, CAST(NULL AS VARCHAR) AS fact FROM citation_labels
UNION ALL SELECT file_name, pos, CAST(NULL AS INTEGER), fact FROM fact_labels""",
        "citation_labels",
        "fact_labels",
    )
    out["files_semi"] = with_views(
        """SELECT file_name, pos, paragraph FROM kept
WHERE file_name IN (SELECT file_name FROM citation_part WHERE citation = 1)""",
        "kept",
        "citation_part",
    )
    out["files_anti"] = with_views(
        """SELECT file_name, pos, paragraph FROM kept k
WHERE NOT EXISTS (SELECT 1 FROM citation_part c WHERE c.citation = 1 AND c.file_name = k.file_name)""",
        "kept",
        "citation_part",
    )
    out["left_merge"] = with_views(
        """SELECT k.file_name, k.pos AS pos_x, k.paragraph, c.pos AS pos_y, c.citation
FROM kept k LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, paragraph ORDER BY pos) AS rn
                 FROM citation_part) WHERE rn = 1) c
  ON k.paragraph IS NOT DISTINCT FROM c.paragraph AND k.file_name IS NOT DISTINCT FROM c.file_name""",
        "kept",
        "citation_part",
    )
    out["natural_left_merge"] = with_views(
        """SELECT k.file_name, k.pos, k.paragraph, c.citation
FROM kept k LEFT JOIN citation_part c
  ON k.file_name IS NOT DISTINCT FROM c.file_name AND k.pos IS NOT DISTINCT FROM c.pos
 AND k.paragraph IS NOT DISTINCT FROM c.paragraph""",
        "kept",
        "citation_part",
    )
    out["positional_join"] = with_views(
        """SELECT a.file_name, a.pos, a.paragraph, b.fact
FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY pos) AS i FROM kept) a
LEFT JOIN (SELECT file_name, fact, row_number() OVER (PARTITION BY file_name ORDER BY pos) AS i
           FROM (SELECT *, row_number() OVER (PARTITION BY file_name, pos ORDER BY dup) AS rn FROM fact_part)
           WHERE rn = 1) b
  ON a.file_name = b.file_name AND a.i = b.i""",
        "kept",
        "fact_part",
    )
    out["frames_equal"] = with_views(
        """SELECT count(*) = 0 AS equal, CAST(count(*) AS BIGINT) AS n_diff
FROM (SELECT file_name, paragraph, count(*) AS n FROM kept GROUP BY ALL) a
FULL OUTER JOIN (SELECT file_name, paragraph, count(*) AS n FROM cons GROUP BY ALL) b
  ON a.file_name IS NOT DISTINCT FROM b.file_name AND a.paragraph IS NOT DISTINCT FROM b.paragraph
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
        "kept",
        "cons",
    )
    out["consolidate_labels"] = with_views("SELECT * FROM cons", "cons")
    out["new_main_text"] = with_views(
        r"""SELECT file_name, gid AS ord, paragraph, 'numbered' AS source FROM numbered
WHERE file_name IN (SELECT * FROM several)
UNION ALL
SELECT file_name, pos AS ord, paragraph, 'main' AS source FROM kept
WHERE file_name NOT IN (SELECT * FROM several)""",
        "kept",
        "numbered",
        "several",
    )
    split_case = """CASE WHEN rk < floor(CAST(0.7 AS DOUBLE) * n) THEN 'train'
            WHEN rk < floor(CAST(0.7 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n) THEN 'validation'
            ELSE 'test' END"""
    gsplit = f"""SELECT k.file_name, k.pos, {split_case} AS split
FROM kept k JOIN (SELECT file_name, row_number() OVER (ORDER BY md5('42|' || file_name), file_name) - 1 AS rk,
                         count(*) OVER () AS n
                  FROM (SELECT DISTINCT file_name FROM kept)) r USING (file_name)"""
    out["group_split"] = with_views(gsplit, "kept")
    out["split_sizes"] = with_views(
        f"""SELECT split, CAST(count(DISTINCT file_name) AS BIGINT) AS n_units, CAST(count(*) AS BIGINT) AS n_rows
FROM ({gsplit}) GROUP BY split""",
        "kept",
    )
    return out


# ----------------------------------------------------------------- batch 3
from casepipe.functions.tags import TAGS  # noqa: E402

TAG_LIST = "[" + ", ".join(q(t) for t in TAGS) + "]"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def decoded(x: str) -> str:
    """The character references that occur in the pages, decoded (``&`` last)."""
    out = f"regexp_replace({x}, '&amp;?', chr(1), 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"replace({out}, chr(1), '&')"


def tag_id_sql(x: str) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {x} = {q(t)} THEN {i}" for i, t in enumerate(TAGS)) + " ELSE 0 END AS INTEGER)"


def tag_type(x: str) -> str:
    return f"CASE WHEN {x} = 'O' THEN NULL ELSE regexp_extract({x}, '([^-]*)$', 1) END"


MORE_VIEWS = {
    "search_results": (
        (),
        r"""
SELECT page_id, CAST(page_id % 10 AS INTEGER) AS item,
       CASE WHEN page_id % 40 <= 1 THEN 'Case ' || (page_id // 40) ELSE regexp_extract(html, '<h1>(.*?)</h1>', 1) END AS title,
       CASE page_id % 4 WHEN 0 THEN 'High Court' WHEN 1 THEN 'Court of Appeal' ELSE 'Supreme Court' END AS court,
       CASE page_id % 4
         WHEN 0 THEN '[' || (2000 + page_id % 24) || '] EWHC ' || (page_id + 100) || ' (Admin)'
         WHEN 1 THEN '[' || (2000 + page_id % 24) || '] EWCA Civ ' || (page_id + 100)
         WHEN 2 THEN '  [' || (2000 + page_id % 24) || ']   UKSC ' || (page_id % 50 + 1) || ' '
         ELSE '[' || (2000 + page_id % 24) || '] UKSC' END AS citation,
       (2000 + page_id % 24) || '-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-15T00:00:00' AS date,
       CAST(page_id // 10 + 1 AS INTEGER) AS page
FROM pages
""",
    ),
    "cit_uri": (
        ("search_results",),
        r"""
SELECT *,
  CASE WHEN len(parts) = 4 AND parts[4] LIKE '%)'
         THEN lower(parts[2]) || '/' || lower(substr(parts[4], 2, length(parts[4]) - 2)) || '/' || substr(parts[1], 2, length(parts[1]) - 2) || '/' || parts[3]
       WHEN len(parts) = 4 AND regexp_matches(parts[4], '^[0-9]+$')
         THEN lower(parts[2]) || '/' || lower(parts[3]) || '/' || substr(parts[1], 2, length(parts[1]) - 2) || '/' || parts[4]
       WHEN len(parts) = 3
         THEN lower(parts[2]) || '/' || substr(parts[1], 2, length(parts[1]) - 2) || '/' || parts[3]
       ELSE 'Invalid input format' END AS uri
FROM (SELECT *, regexp_split_to_array(regexp_replace(citation, '^\s+|\s+$', '', 'g'), '\s+') AS parts FROM search_results)
""",
    ),
    "page_totals": (
        (),
        r"""
SELECT page_id, url,
       CASE WHEN page_id % 5 = 0 THEN format('{:,}', n * 100) ELSE CAST(n AS VARCHAR) END || ' documents found' AS total_text
FROM (SELECT page_id, url, ((length(html) - length(replace(html, '<p', ''))) // 2) * 3 + page_id % 10 AS n FROM pages)
""",
    ),
    "words": (
        (),
        f"""
SELECT doc_id, idx, word, b AS bucket, CASE WHEN b < 11 THEN {TAG_LIST}[b + 1] ELSE 'O' END AS tag
FROM (SELECT doc_id, CAST(idx AS INTEGER) AS idx, word,
             strpos('0123456789abcdef', substr(md5(word), 1, 1)) - 1 AS b
      FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS idx
            FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
                  FROM documents)))
""",
    ),
    "doc_lines": (
        ("words",),
        r"""
SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS base, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS "end" FROM (
  SELECT d.doc_id, coalesce(w.n, 0) + coalesce(w.n, 0) // 10 + 1 + CASE WHEN d.doc_id % 9 = 0 THEN 1 ELSE 0 END AS n
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) w ON d.doc_id = w.doc_id)
""",
    ),
    "iob_lines": (
        ("words", "doc_lines"),
        r"""
SELECT 'output-iob.tsv' AS file, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT base + idx + idx // 10 + 1 AS line_no,
         CASE WHEN idx % 13 = 12 THEN word || chr(9)
              WHEN idx % 17 = 16 THEN word || chr(9) || '_' || chr(9) || '_' || chr(9) || tag
              ELSE word || chr(9) || tag END AS line FROM words JOIN doc_lines USING (doc_id)
  UNION ALL SELECT base + idx + idx // 10 + 2, '' FROM words JOIN doc_lines USING (doc_id) WHERE idx % 10 = 9
  UNION ALL SELECT base, '-DOCSTART- -X- O O' FROM doc_lines
  UNION ALL SELECT "end" - 1, '-DOCSTART- -X- O O' FROM doc_lines WHERE doc_id % 9 = 0)
""",
    ),
    "ner_pred": (
        ("words",),
        f"""
SELECT doc_id, idx, word, true_tag,
       CASE WHEN substr(md5(word || '#'), 1, 1) IN ('0', '1', '2') THEN {TAG_LIST}[(bucket + 3) % 11 + 1] ELSE true_tag END AS pred_tag
FROM (SELECT *, CASE WHEN idx % 13 = 12 THEN 'O' ELSE tag END AS true_tag FROM words)
""",
    ),
    "ml_pred": (
        (),
        r"""
SELECT l.doc_id, [CAST(quality AS INTEGER), CAST(toxic AS INTEGER)] AS y,
       [CAST((n_chars % 1000) AS DOUBLE) / 250.0 - 2.0,
        CAST(strpos('0123456789abcdef', substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 1)) - 1 AS DOUBLE) / 4.0 - 2.0] AS logits
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""",
    ),
}


def _chunks_sql(col: str, table: str = "ner_pred") -> str:
    start = (
        f"tag <> 'O' AND (split_part(tag, '-', 1) = 'B' OR prev = 'O' OR "
        f"({tag_type('tag')}) IS DISTINCT FROM ({tag_type('prev')}))"
    )
    return f"""
SELECT doc_id, min(idx) AS s, max(idx) AS e, arg_min(typ, idx) AS typ FROM (
  SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS ch,
         {tag_type('tag')} AS typ
  FROM (SELECT doc_id, idx, {col} AS tag, lag({col}, 1, 'O') OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM {table}))
WHERE tag <> 'O' GROUP BY doc_id, ch"""


def oracle_sql_more() -> dict[str, str]:
    VIEWS.update(MORE_VIEWS)
    out: dict[str, str] = {}
    out["listing_items"] = f"""
SELECT page_id, CAST(item AS INTEGER) AS item,
       {strip(decoded("regexp_replace(regexp_extract(li, '(?s)<a[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')"))} AS title,
       {strip(decoded("regexp_replace(regexp_extract(li, 'href=\"([^\"]*)\"', 1), '<[^>]*>', '', 'g')"))} AS href
FROM (SELECT page_id, unnest(l) AS li, generate_subscripts(l, 1) - 1 AS item
      FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>\\s*<ul>(.*?)</ul>', 1), '(?s)<li[^>]*>(.*?)</li>', 1) AS l
            FROM pages))"""
    out["page_plan"] = with_views(
        """SELECT page_id, CAST(g AS INTEGER) AS page, base || '/search?query="planning+court"&page=' || g AS url
FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base,
             CAST(replace(regexp_extract(total_text, '^(\\S+)', 1), ',', '') AS BIGINT) AS total FROM page_totals) t,
     range(1, CAST(ceil(total / 10.0) AS BIGINT) + 1) r(g)""",
        "page_totals",
    )
    out["feed_title_id"] = with_views(
        f"SELECT {strip('title')} AS title, arg_max('id-' || page_id, page_id) AS entry_id FROM search_results GROUP BY 1", "search_results"
    )
    out["search_results_flatten"] = with_views(
        """SELECT CAST(row_number() OVER (PARTITION BY page ORDER BY item) - 1 AS INTEGER) AS page_item,
       title, court, citation, date, page FROM search_results""",
        "search_results",
    )
    out["search_file_roundtrip"] = out["search_results_flatten"]
    title, court, citation = (strip(c) for c in ("title", "court", "citation"))
    out["listing_fields"] = with_views(
        f"SELECT page, item, {title} AS title, {court} AS court, {citation} AS citation, date FROM search_results", "search_results"
    )
    out["listing_tree"] = with_views(
        f"SELECT page, item, {title} AS title, {court} || chr(39) || 's' AS court, {citation} AS citation, date FROM search_results", "search_results"
    )
    out["citation_uri"] = with_views("SELECT page_id, citation, uri FROM cit_uri", "cit_uri")
    out["download_manifest"] = with_views(
        """SELECT arg_max(title, page_id) AS title, arg_max(citation, page_id) AS citation, arg_max(page, page_id) AS page,
       arg_max(uri, page_id) AS uri, arg_max(url, page_id) AS url, target_path, CAST(count(*) AS BIGINT) AS collisions
FROM (SELECT *, 'https://caselaw.nationalarchives.gov.uk/' || uri || '/data.xml' AS url,
             './data/xml_data/xml_page_' || page || '/' || replace(title, '/', '_') || '.xml' AS target_path
      FROM cit_uri)
GROUP BY target_path""",
        "cit_uri",
    )
    out["pdf_manifest"] = (
        out["download_manifest"].replace("/data.xml", "/data.pdf").replace("./data/xml_data/xml_page_", "./data/pdf_data/pdf_page_").replace("'.xml'", "'.pdf'")
    )
    out["page_folders"] = with_views(
        """SELECT CAST(g AS INTEGER) AS page, 'xml_page_' || g AS folder
FROM range(1, (SELECT max(page) FROM search_results) + 1) r(g)""",
        "search_results",
    )
    main_filter = r"""length(paragraph) - length(replace(paragraph, '-', '')) <= 2
  AND regexp_matches(paragraph, '\S') AND regexp_matches(paragraph, '[\p{L}\p{N}]')"""
    out["main_paragraphs"] = f"""
SELECT * FROM (SELECT page_id, CAST(i - 2 AS INTEGER) AS pos,
       {strip(decoded("regexp_replace(regexp_replace(piece, '(?s)(</p>|</article>).*$', ''), '<[^>]*>', '', 'g')"))} AS paragraph
FROM (SELECT page_id, unnest(arr) AS piece, generate_subscripts(arr, 1) AS i
      FROM (SELECT page_id, string_split_regex(html, '<p[^>]*>') AS arr FROM pages))
WHERE i > 1) WHERE {main_filter}"""
    akn_main = f"""SELECT file_name, CAST(pos - 2 AS INTEGER) AS pos, paragraph || chr(10) AS paragraph
FROM paras WHERE pos >= 2 AND {main_filter}"""
    out["akn_main_paragraphs"] = with_views(akn_main, "paras")
    akn_cover = r"""SELECT file_name,
       coalesce(string_agg(paragraph || chr(10), '' ORDER BY pos)
                FILTER (WHERE length(paragraph) - length(replace(paragraph, '-', '')) <= 2
                          AND regexp_matches(paragraph || chr(10), '\S')), '') AS cover_text
FROM paras WHERE pos < 2 GROUP BY file_name"""
    out["akn_cover"] = with_views(akn_cover, "paras")
    akn_seg = f"""SELECT file_name, CAST(seg AS INTEGER) AS seg, {strip("string_agg(v, ' ' ORDER BY pos, k)")} AS segment
FROM (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY pos, k) AS seg
      FROM (SELECT file_name, pos, 0 AS k,
                   CASE WHEN pos % 14 = 7 THEN '(' || pos || ')' ELSE (pos + 1) || '.' END AS v
            FROM paras WHERE pos >= 2 AND pos % 7 = 0
            UNION ALL SELECT file_name, pos, 1, {strip("paragraph")} FROM paras WHERE pos >= 2 AND paragraph <> ''
            UNION ALL SELECT file_name, pos, 2, '' FROM paras WHERE pos >= 2))
WHERE seg >= 1 GROUP BY file_name, seg"""
    out["akn_segments"] = with_views(akn_seg, "paras")
    out["akn_numbered"] = with_views(
        f"""SELECT file_name, CAST(gid AS INTEGER) AS gid, {strip("string_agg(segment, ' ' ORDER BY seg)")} AS paragraph
FROM (SELECT *, sum(CASE WHEN regexp_matches(segment, '^\\d+\\.') THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY seg) AS gid
      FROM ({akn_seg}))
GROUP BY file_name, gid""",
        "paras",
    )
    out["akn_case_tables"] = with_views(
        f"""SELECT f.file_name, f.error_kind, CASE WHEN f.error_kind IS NULL THEN c.cover_text END AS cover_text,
       CASE WHEN f.error_kind IS NULL THEN coalesce(m.n, 0) ELSE 0 END AS n_paragraphs,
       CASE WHEN f.error_kind IS NULL THEN CAST(coalesce(m.chars, 0) AS BIGINT) ELSE 0 END AS paragraph_chars,
       CASE WHEN f.error_kind IS NULL THEN coalesce(s.n, 0) ELSE 0 END AS n_segments,
       CASE WHEN f.error_kind IS NULL THEN CAST(coalesce(s.chars, 0) AS BIGINT) ELSE 0 END AS segment_chars
FROM (SELECT DISTINCT file_name, CASE doc_id % 50 WHEN 7 THEN 'parse' WHEN 8 THEN 'encoding' END AS error_kind FROM paras) f
LEFT JOIN ({akn_cover}) c USING (file_name)
LEFT JOIN (SELECT file_name, count(*) AS n, sum(length(paragraph)) AS chars FROM ({akn_main}) GROUP BY file_name) m USING (file_name)
LEFT JOIN (SELECT file_name, count(*) AS n, sum(length(segment)) AS chars FROM ({akn_seg}) GROUP BY file_name) s USING (file_name)""",
        "paras",
    )
    out["xml_quarantine"] = with_views("SELECT DISTINCT file_name FROM paras WHERE doc_id % 50 IN (7, 8)", "paras")
    out["segments"] = with_views(
        f"""WITH ev AS (SELECT file_name, pos AS ev, CASE WHEN pos % 7 IN (0, 3) THEN 'num' ELSE 'p' END AS tag,
                   pos % 7 = 0 AS styled, paragraph AS text, CASE WHEN pos % 2 = 0 THEN chr(10) END AS tail FROM paras),
s AS (SELECT *, sum(CASE WHEN styled THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY ev) AS seg FROM ev),
pcs AS (SELECT file_name, seg, ev, 0 AS k, {strip("text")} AS v FROM s
        WHERE seg >= 1 AND text IS NOT NULL AND text <> '' AND (tag <> 'num' OR styled)
        UNION ALL
        SELECT file_name, seg, ev, 1, {strip("tail")} FROM s
        WHERE seg >= 1 AND tail IS NOT NULL AND tail <> '' AND tag <> 'num'),
heads AS (SELECT file_name, seg FROM s WHERE styled),
j AS (SELECT file_name, seg, string_agg(v, ' ' ORDER BY ev, k) AS t FROM pcs GROUP BY file_name, seg),
lst AS (SELECT file_name, max(seg) AS mx FROM heads GROUP BY file_name)
SELECT h.file_name, CAST(h.seg AS INTEGER) AS seg, {strip("coalesce(j.t, '')")} AS segment
FROM heads h JOIN lst USING (file_name) LEFT JOIN j ON h.file_name = j.file_name AND h.seg = j.seg
WHERE j.t IS NOT NULL OR h.seg < lst.mx""",
        "paras",
    )
    out["batch_label"] = with_views(
        f"""SELECT file_name, pos, CASE WHEN regexp_matches(paragraph, {FACT}) THEN '1' ELSE '0' END AS output,
       CAST(NULL AS VARCHAR) AS error FROM kept""",
        "kept",
    )
    out["label_resume"] = with_views(
        """SELECT file_name, pos, paragraph FROM kept k
WHERE NOT EXISTS (SELECT 1 FROM fact_part f WHERE f.file_name = k.file_name AND f.pos = k.pos)""",
        "kept",
        "fact_part",
    )
    iob_docs = f"""SELECT CAST(row_number() OVER (ORDER BY doc) - 1 AS VARCHAR) AS id, tokens, ner_tags FROM (
  SELECT doc, list(parts[1] ORDER BY line_no) AS tokens, list({tag_id_sql('parts[-1]')} ORDER BY line_no) AS ner_tags
  FROM (SELECT doc, line_no, string_split(s, chr(9)) AS parts
        FROM (SELECT *, sum(CASE WHEN starts_with(s, '-DOCSTART- -X-') THEN 1 ELSE 0 END) OVER (ORDER BY line_no) AS doc
              FROM (SELECT line_no, {strip('line')} AS s FROM iob_lines))
        WHERE s <> '' AND NOT starts_with(s, '-DOCSTART- -X-'))
  GROUP BY doc)"""
    out["iob_documents"] = with_views(iob_docs, "iob_lines")
    out["iob_file_roundtrip"] = out["iob_documents"]
    iob_tok = f"""SELECT line_no, parts[1] AS word, parts[2] AS tag
FROM (SELECT line_no, {strip('line')} AS s, regexp_split_to_array({strip('line')}, '\\s+') AS parts
      FROM iob_lines WHERE NOT starts_with(line, '-DOCSTART-'))
WHERE s <> '' AND len(parts) = 2"""
    out["iob_tokens"] = with_views(iob_tok, "iob_lines")
    out["entity_counts"] = with_views(
        f"SELECT substr(tag, 3) AS entity, CAST(count(*) AS BIGINT) AS count FROM ({iob_tok}) WHERE starts_with(tag, 'B-') GROUP BY 1",
        "iob_lines",
    )
    out["tag_ids"] = with_views(
        f"""SELECT line_no, tag, {tag_id_sql('tag')} AS tag_id, {TAG_LIST}[{tag_id_sql('tag')} + 1] AS tag_name
FROM (SELECT line_no, string_split(s, chr(9))[-1] AS tag
      FROM (SELECT line_no, {strip('line')} AS s FROM iob_lines) WHERE s <> '' AND NOT starts_with(s, '-DOCSTART-'))""",
        "iob_lines",
    )
    out["align_labels"] = with_views(
        f"""SELECT doc_id,
       [-100] || flatten(list(repeat([t], n) ORDER BY idx)) || [-100] AS labels,
       [-100] || flatten(list([t] || repeat([-100], n - 1) ORDER BY idx)) || [-100] AS labels_first
FROM (SELECT doc_id, idx, {tag_id_sql('true_tag')} AS t, CAST(ceil(length(word) / 4.0) AS INTEGER) AS n FROM ner_pred)
GROUP BY doc_id""",
        "ner_pred",
    )
    out["argmax_decode"] = with_views(
        f"""SELECT doc_id, idx, {TAG_LIST}[(CASE WHEN idx % 7 = 0 THEN least(pid, (pid + 5) % 11) ELSE pid END) + 1] AS pred_tag
FROM (SELECT doc_id, idx, {tag_id_sql('pred_tag')} AS pid FROM ner_pred WHERE idx % 9 <> 8)""",
        "ner_pred",
    )
    out["row_split"] = with_views(
        f"""SELECT id, CASE WHEN rk < n - m THEN 'train' WHEN rk < n - m + (m - ceil(0.5 * m)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT id, rk, n, ceil((CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * n) AS m
      FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS rk, count(*) OVER () AS n FROM ({iob_docs})))""",
        "iob_lines",
    )
    ent = f"""WITH tc AS ({_chunks_sql('true_tag')}), pc AS ({_chunks_sql('pred_tag')}),
c AS (SELECT (SELECT count(*) FROM tc) AS n_true, (SELECT count(*) FROM pc) AS n_pred,
             (SELECT count(*) FROM tc JOIN pc ON tc.doc_id = pc.doc_id AND tc.s = pc.s AND tc.e = pc.e AND tc.typ = pc.typ) AS tp,
             (SELECT avg(CASE WHEN true_tag = pred_tag THEN 1.0 ELSE 0.0 END) FROM ner_pred) AS accuracy),
m AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS p, CASE WHEN n_true = 0 THEN 0.0 ELSE tp / n_true END AS r FROM c)"""
    out["ner_entity_scores"] = with_views(
        ent + """
SELECT CAST(p AS DOUBLE) AS precision, CAST(r AS DOUBLE) AS recall,
       CAST(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS DOUBLE) AS f1, CAST(accuracy AS DOUBLE) AS accuracy,
       CAST(n_true AS BIGINT) AS n_true, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp FROM m""",
        "ner_pred",
    )
    pieces = out["ner_entity_scores"].replace("FROM ner_pred", "FROM ner_pieces")
    view = """ner_pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) - 1 AS idx, true_tag, pred_tag
FROM (SELECT doc_id, idx, true_tag, pred_tag, unnest(range(CAST(ceil(length(word) / 4.0) AS INTEGER))) AS k FROM ner_pred)),
"""
    out["ner_piece_scores"] = pieces.replace("tc AS (", view + "tc AS (", 1)
    auc = """(SELECT CAST(CASE WHEN pp = 0 THEN (base + 1) / 2
                 ELSE (1 - r1) * (base + p1) / 2 + r1 * (p1 + 1) / 2 END AS DOUBLE) AS auc_pr
 FROM (SELECT pp, pos / n AS base, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p1, CASE WHEN pos = 0 THEN 0 ELSE tp / pos END AS r1
       FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN true_tag <> 'O' THEN 1 ELSE 0 END) AS pos,
                    sum(CASE WHEN pred_tag <> 'O' THEN 1 ELSE 0 END) AS pp,
                    sum(CASE WHEN true_tag <> 'O' AND pred_tag <> 'O' THEN 1 ELSE 0 END) AS tp FROM ner_pred)))"""
    out["ner_auc_pr"] = with_views(f"SELECT * FROM {auc}", "ner_pred")
    out["ner_metrics"] = with_views(
        ent + f"""
SELECT CAST(p AS DOUBLE) AS precision, CAST(r AS DOUBLE) AS recall,
       CAST(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS DOUBLE) AS f1, CAST(accuracy AS DOUBLE) AS accuracy,
       a.auc_pr, 'casepipe' AS method FROM m, {auc} a""",
        "ner_pred",
    )
    out["tag_report"] = with_views(
        f"""SELECT class, precision, recall,
       CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support
FROM (SELECT v.class,
       CAST(CASE WHEN coalesce(p.n, 0) = 0 THEN 0.0 ELSE coalesce(t.n, 0) / p.n END AS DOUBLE) AS precision,
       CAST(CASE WHEN coalesce(s.n, 0) = 0 THEN 0.0 ELSE coalesce(t.n, 0) / s.n END AS DOUBLE) AS recall,
       CAST(coalesce(s.n, 0) AS BIGINT) AS support
FROM (SELECT unnest({TAG_LIST}) AS class) v
LEFT JOIN (SELECT true_tag AS class, count(*) AS n FROM ner_pred GROUP BY 1) s USING (class)
LEFT JOIN (SELECT pred_tag AS class, count(*) AS n FROM ner_pred GROUP BY 1) p USING (class)
LEFT JOIN (SELECT true_tag AS class, count(*) AS n FROM ner_pred WHERE true_tag = pred_tag GROUP BY 1) t USING (class))""",
        "ner_pred",
    )
    out["token_features"] = with_views(
        r"""SELECT doc_id, idx, word,
       lag(word) OVER (PARTITION BY doc_id ORDER BY idx) AS prev_word,
       lead(word) OVER (PARTITION BY doc_id ORDER BY idx) AS next_word,
       regexp_replace(regexp_replace(regexp_replace(word, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '\d', 'd', 'g') AS shape,
       right(word, 3) AS suffix
FROM ner_pred""",
        "ner_pred",
    )
    cells = """(SELECT doc_id, 0 AS label, y[1] AS y, CASE WHEN 1 / (1 + exp(-logits[1])) >= 0.3 THEN 1 ELSE 0 END AS p FROM ml_pred
 UNION ALL
 SELECT doc_id, 1 AS label, y[2] AS y, CASE WHEN 1 / (1 + exp(-logits[2])) >= 0.3 THEN 1 ELSE 0 END AS p FROM ml_pred)"""
    per = f"""(SELECT label,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS roc_auc,
        (tp + fn = 0 OR tn + fp = 0) AS single_class
 FROM (SELECT label, CAST(sum(y * p) AS DOUBLE) AS tp, CAST(sum((1 - y) * p) AS DOUBLE) AS fp,
              CAST(sum(y * (1 - p)) AS DOUBLE) AS fn, CAST(sum((1 - y) * (1 - p)) AS DOUBLE) AS tn
       FROM {cells} GROUP BY label))"""
    out["sigmoid_threshold"] = with_views(
        "SELECT doc_id, list_transform(logits, lambda x: CAST(CASE WHEN 1 / (1 + exp(-x)) >= 0.3 THEN 1 ELSE 0 END AS INTEGER)) AS pred FROM ml_pred",
        "ml_pred",
    )
    out["multilabel_f1"] = with_views(f"SELECT CAST(avg(f1) AS DOUBLE) AS f1 FROM {per}", "ml_pred")
    out["multilabel_roc_auc"] = with_views(
        f"SELECT CAST(avg(roc_auc) AS DOUBLE) AS roc_auc, bool_or(single_class) AS undefined_label FROM {per}", "ml_pred"
    )
    out["roc_auc_prob"] = with_views(
        """SELECT CAST(avg(auc) AS DOUBLE) AS roc_auc_prob FROM (
  SELECT label, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN sum(CASE WHEN y = 1 THEN below + same / 2.0 END) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS auc
  FROM (SELECT label, y, sum(1 - y) OVER (PARTITION BY label ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y) OVER (PARTITION BY label, s) AS below,
               sum(1 - y) OVER (PARTITION BY label, s) AS same
        FROM (SELECT 0 AS label, y[1] AS y, logits[1] AS s FROM ml_pred UNION ALL SELECT 1, y[2], logits[2] FROM ml_pred))
  GROUP BY label)""",
        "ml_pred",
    )
    out["multilabel_hamming"] = with_views(
        f"SELECT CAST(avg(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS hamming_loss FROM {cells}", "ml_pred"
    )
    out["multilabel_metrics"] = with_views(
        f"""SELECT a.roc_auc, h.hamming_loss, a.f1, 'casepipe' AS method
FROM (SELECT CAST(avg(roc_auc) AS DOUBLE) AS roc_auc, CAST(avg(f1) AS DOUBLE) AS f1 FROM {per}) a,
     (SELECT CAST(avg(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS hamming_loss FROM {cells}) h""",
        "ml_pred",
    )
    return out


def oracle_sql() -> dict[str, str]:
    out = _base_sql() | oracle_sql_more()
    odd = """CASE pos % 12 WHEN 0 THEN '  ' || chr(9) || paragraph WHEN 1 THEN paragraph || ' ' || chr(10)
            WHEN 2 THEN '"a", "b"' || chr(10) || 'line two, ' || paragraph
            WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN 'null' ELSE paragraph END"""
    gsplit = out["group_split"]
    labels = ("introduction", "fact", "citation", "judgment")
    words = "WORDS AS (SELECT c.*, s.split, unnest(string_split(lower(paragraph), ' ')) AS w FROM cons c JOIN SPLIT s ON c.file_name = s.file_name AND c.pos = s.pos)"
    sums = ", ".join(f"sum({c}) AS p{i}" for i, c in enumerate(labels))
    tots = ", ".join(f"sum(p{i}) AS t{i}" for i in range(4))
    rows_ = ", ".join(f"sum({c}) AS r{i}" for i, c in enumerate(labels))
    odds = ", ".join(
        f"sum(ln((coalesce(p{i}, 0) + 1) / (t{i} + v)) - ln((coalesce(n - p{i}, 0) + 1) / (t - t{i} + v))) + max(ln((r{i} + 1) / (rws - r{i} + 1))) AS s{i}"
        for i in range(4)
    )
    cells = " UNION ALL ".join(
        f"SELECT {i} AS label, {c} AS y, CASE WHEN 1 / (1 + exp(-s{i})) >= 0.3 THEN 1 ELSE 0 END AS p FROM sc" for i, c in enumerate(labels)
    )
    bayes = with_views(
        f"""{words.replace('WORDS', 'wrd').replace('SPLIT', 'spl')},
cnt AS (SELECT w, count(*) AS n, {sums} FROM wrd WHERE split = 'train' GROUP BY w),
tot AS (SELECT count(*) AS v, sum(n) AS t, {tots} FROM cnt),
pri AS (SELECT count(*) AS rws, {rows_} FROM cons c JOIN spl s ON c.file_name = s.file_name AND c.pos = s.pos WHERE split = 'train'),
sc AS (SELECT d.file_name, d.pos, {', '.join(f'max({c}) AS {c}' for c in labels)}, {odds}
       FROM wrd d LEFT JOIN cnt ON d.w = cnt.w, tot, pri WHERE split = 'test' GROUP BY d.file_name, d.pos),
cells AS ({cells}),
per AS (SELECT label, CAST(sum(y * p) AS DOUBLE) AS tp, CAST(sum((1 - y) * p) AS DOUBLE) AS fp, CAST(sum(y * (1 - p)) AS DOUBLE) AS fn,
               CAST(sum((1 - y) * (1 - p)) AS DOUBLE) AS tn FROM cells GROUP BY label)
SELECT CAST(avg(CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END) AS DOUBLE) AS roc_auc,
       CAST(sum(fp + fn) / sum(tp + fp + fn + tn) AS DOUBLE) AS hamming_loss,
       CAST(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS DOUBLE) AS f1, 'bayes' AS method FROM per""",
        "cons",
    )
    body = gsplit[gsplit.index("SELECT k.file_name") :]
    out["multilabel_bayes"] = bayes.replace("wrd AS (", f"spl AS ({body}),\nwrd AS (", 1)
    out["token_bayes"] = with_views(
        f"""ids AS (SELECT id, CASE WHEN rk < n - m THEN 'train' WHEN rk < n - m + (m - ceil(0.5 * m)) THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT id, rk, n, ceil((CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * n) AS m
            FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS rk, count(*) OVER () AS n
                  FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM ner_pred)))),
f AS (SELECT doc_id, idx, split, true_tag, {tag_id_sql('true_tag')} AS t, lower(word) AS w, right(lower(word), 3) AS x
      FROM ner_pred JOIN ids ON CAST(doc_id AS VARCHAR) = id),
tr AS (SELECT * FROM f WHERE split = 'train'),
sz AS (SELECT g.t, count(tr.t) AS n FROM (SELECT unnest(range(11)) AS t) g LEFT JOIN tr ON tr.t = g.t GROUP BY g.t),
cw AS (SELECT w, t, count(*) AS c FROM tr GROUP BY w, t), cx AS (SELECT x, t, count(*) AS c FROM tr GROUP BY x, t),
v AS (SELECT (SELECT count(DISTINCT w) FROM tr) AS vw, (SELECT count(DISTINCT x) FROM tr) AS vx),
sc AS (SELECT f.doc_id, f.idx, f.true_tag, sz.t, ln(sz.n + 1) + ln((coalesce(cw.c, 0) + 1) / (sz.n + vw)) + ln((coalesce(cx.c, 0) + 1) / (sz.n + vx)) AS s
       FROM f JOIN sz ON true LEFT JOIN cw ON cw.w = f.w AND cw.t = sz.t LEFT JOIN cx ON cx.x = f.x AND cx.t = sz.t, v WHERE f.split = 'test'),
best AS (SELECT doc_id, idx, true_tag, t FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY s DESC, t) = 1)
SELECT true_tag, {TAG_LIST}[t + 1] AS pred_tag, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY 1, 2""",
        "ner_pred",
    )
    learned = out["token_bayes"][out["token_bayes"].index("ids AS (SELECT id, CASE") : out["token_bayes"].index("sc AS (SELECT f.doc_id")]
    out["token_viterbi"] = with_views(
        f"""{learned}
em AS MATERIALIZED (SELECT doc_id, idx, true_tag, list(s ORDER BY t) AS e
       FROM (SELECT f.doc_id, f.idx, f.true_tag, sz.t,
                    floor(1000 * (ln((coalesce(cw.c, 0) + 1) / (sz.n + vw + 1)) + ln((coalesce(cx.c, 0) + 1) / (sz.n + vx + 1)))) AS s
             FROM f JOIN sz ON true LEFT JOIN cw ON cw.w = f.w AND cw.t = sz.t LEFT JOIN cx ON cx.x = f.x AND cx.t = sz.t, v WHERE f.split = 'test')
       GROUP BY ALL),
pairs AS (SELECT p, t, count(*) AS c FROM (SELECT t, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY idx), 11) AS p FROM tr) GROUP BY ALL),
steps AS (SELECT g.p, g.t, CASE WHEN g.t = 0 OR g.t % 2 = 1 OR g.p IN (g.t - 1, g.t) THEN coalesce(c, 0) + 1 END AS n
          FROM (SELECT p, t FROM (SELECT unnest(range(12)) AS p), (SELECT unnest(range(11)) AS t)) g LEFT JOIN pairs USING (p, t)),
a AS MATERIALIZED (SELECT list(r ORDER BY t) AS a FROM (SELECT t, list(w ORDER BY p) AS r
       FROM (SELECT p, t, coalesce(floor(1000 * ln(n / sum(n) OVER (PARTITION BY p))), -1e15) AS w FROM steps) GROUP BY t)),
vit AS MATERIALIZED (
  SELECT doc_id, idx, [a[j][12] + e[j] FOR j IN range(1, 12)] AS d, CAST([] AS INTEGER[]) AS b FROM em, a WHERE idx = 0
  UNION ALL
  SELECT doc_id, idx, [list_max(x[j]) + e[j] FOR j IN range(1, 12)], [CAST(list_position(x[j], list_max(x[j])) AS INTEGER) FOR j IN range(1, 12)]
  FROM (SELECT em.doc_id, em.idx, em.e, [[vit.d[i] + a[j][i] FOR i IN range(1, 12)] FOR j IN range(1, 12)] AS x
        FROM vit JOIN em ON em.doc_id = vit.doc_id AND em.idx = vit.idx + 1, a)),
path AS (
  SELECT doc_id, idx, CAST(list_position(d, list_max(d)) AS INTEGER) AS t FROM vit QUALIFY idx = max(idx) OVER (PARTITION BY doc_id)
  UNION ALL
  SELECT path.doc_id, path.idx - 1, vit.b[path.t] FROM path JOIN vit ON vit.doc_id = path.doc_id AND vit.idx = path.idx WHERE path.idx > 0)
SELECT true_tag, {TAG_LIST}[path.t] AS pred_tag, CAST(count(*) AS BIGINT) AS n FROM path JOIN em USING (doc_id, idx) GROUP BY 1, 2""",
        "ner_pred",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    out["csv_roundtrip"] = with_views(
        f"""SELECT file_name, pos, {odd} AS paragraph, CAST(0 AS INTEGER) AS introduction,
       CAST(regexp_matches(paragraph, {FACT}) AS INTEGER) AS fact,
       CAST(regexp_matches(paragraph, {CIT}) AS INTEGER) AS citation,
       CAST(0 AS INTEGER) AS judgment
FROM kept""",
        "kept",
    )
    out["annotation_export_manifest"] = with_views(
        f"""SELECT regexp_extract(regexp_extract(file_name, '([^/\\\\]*)[/\\\\][^/\\\\]*$', 1), '([^_]*)$', 1) AS page,
       substr(regexp_extract(file_name, '([^/\\\\]*)$', 1), 1, length(regexp_extract(file_name, '([^/\\\\]*)$', 1)) - 4) AS case_name,
       CAST(count(*) AS BIGINT) AS n_rows
FROM kept GROUP BY 1, 2""",
        "kept",
    )
    out["annotation_read"] = with_views(
        f"""SELECT file_name, pos, {odd} AS paragraph, introduction,
       CAST(regexp_matches(paragraph, {FACT}) AS INTEGER) AS fact,
       CAST(regexp_matches(paragraph, {CIT}) AS INTEGER) AS citation,
       CAST(0 AS INTEGER) AS judgment,
       'The paragraph number is ' || row_number() OVER (PARTITION BY file_name ORDER BY pos) AS paragraph_number
FROM (SELECT *, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE CAST(0 AS INTEGER) END AS introduction FROM kept)""",
        "kept",
    )
    out["annotation_layouts"] = (
        out["annotation_read"].replace("SELECT file_name, pos", "SELECT CASE WHEN doc_id % 3 = 1 THEN NULL ELSE file_name END AS file_name, pos", 1)
        .replace("CASE WHEN doc_id % 3 = 2 THEN NULL ELSE CAST(0 AS INTEGER) END AS introduction", "CAST(0 AS INTEGER) AS introduction")
    )
    out["csv_ranges"] = out["csv_roundtrip"]
    out["label_path"] = out["batch_label"]
    out["label_chunks"] = out["batch_label"]
    out["xml_scan"] = with_views(
        """SELECT 'xml_page_' || (doc_id % 10 + 1) AS folder, 'doc_' || doc_id || '.xml' AS name, true AS has_content
FROM (SELECT DISTINCT doc_id FROM paras)""",
        "paras",
    )
    out["xml_error_report"] = with_views(
        """SELECT CASE WHEN doc_id % 50 = 7 THEN 'parse' ELSE 'encoding' END AS error_kind, CAST(count(DISTINCT file_name) AS BIGINT) AS n_files
FROM paras WHERE doc_id % 50 IN (7, 8) GROUP BY 1""",
        "paras",
    )
    return out
