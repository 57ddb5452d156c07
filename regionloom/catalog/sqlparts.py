"""SQL fragments several oracles share."""


def merged(src: str, min_overlap: int = 0, key: str = "chrom") -> str:
    """Merged intervals of relation ``src`` (a name) as a subselect."""
    return f"""(SELECT {key}, min(start) AS start, max(stop) AS stop FROM (
      SELECT *, sum(CASE WHEN prev_stop IS NULL OR start > prev_stop - {min_overlap} THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(stop) OVER (PARTITION BY {key} ORDER BY start, stop
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_stop FROM {src})) GROUP BY {key}, island)"""


CUT_SITES = """(SELECT chrom, timepoint, rep,
      CASE WHEN strand = '-' THEN stop - 1 ELSE start END AS start,
      CASE WHEN strand = '+' THEN start + 1 ELSE stop END AS stop FROM v_reads)"""

REGION_COUNTS = f"""cut AS {CUT_SITES}, m AS (SELECT * FROM {merged('v_peaks')}),
  c AS (SELECT m.chrom, m.start, m.stop, timepoint, rep, count(*) AS n
        FROM m JOIN cut ON m.chrom = cut.chrom AND cut.start < m.stop AND m.start < cut.stop GROUP BY ALL)"""

TIMEPOINTS = ["d00", "d30", "d60"]
SAMPLES = [f"{t}_{r}" for t in TIMEPOINTS for r in ("b1", "b2")]
ID = "concat(chrom, ':', CAST(start AS VARCHAR), '-', CAST(stop AS VARCHAR))"


def fisher_sql(k: str, drawn: str, marked: str, total: str) -> str:
    """P(X >= k) of a hypergeometric count, all terms added up; lists keep the terms."""
    term = f"exp(lgamma({marked} + 1) - lgamma(x + 1) - lgamma({marked} - x + 1) + lgamma({total} - {marked} + 1) - lgamma({drawn} - x + 1) - lgamma({total} - {marked} - {drawn} + x + 1)"
    term += f" - lgamma({total} + 1) + lgamma({drawn} + 1) + lgamma({total} - {drawn} + 1))"
    return f"least(1.0, coalesce(list_sum([{term} for x in range(CAST(greatest({k}, {drawn} + {marked} - {total}, 0) AS BIGINT), CAST(least({drawn}, {marked}) AS BIGINT) + 1)]), 0))"


#: Genes with a TSS (u) and the members of gene sets among them (m).
MEMBERS = "u AS (SELECT DISTINCT gene_id FROM v_tss), m AS (SELECT DISTINCT set_name, gene_id FROM v_gene_sets WHERE gene_id IN (SELECT gene_id FROM u))"
