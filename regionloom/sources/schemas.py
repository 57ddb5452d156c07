"""Schemas of the headerless text files; nothing is inferred."""

BED3 = "chrom string, start bigint, stop bigint"
BED4 = f"{BED3}, name string"
BED6 = f"{BED4}, score double, strand string"
BEDPE = ("chrom1 string, start1 bigint, stop1 bigint, chrom2 string, start2 bigint, stop2 bigint, "
         "name string, score double, strand1 string, strand2 string")
NARROW_PEAK = f"{BED6}, signal_value double, p_value double, q_value double, summit_offset bigint"
GTF = ("chrom string, source string, feature string, start bigint, stop bigint, score string, "
       "strand string, frame string, attributes string")
INTERACTION = f"{BED3}, name string, unique_id bigint, strand string"
VCF = "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string"
RSEM = "gene_id string, expected_count double, TPM double"
CONTRAST = "id string, base_mean double, log2_fold_change double, padj double"
CLUSTERS = "cluster int, id string"
HOMER_KNOWN = "motif_name string, consensus string, p_value double, log_p double, q_value double"
TERMS = "domain string, term_id bigint, term_name string, p_value double"
