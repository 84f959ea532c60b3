"""Schemas of the record types."""

OVERLAP = "a_name string, b_name string, score bigint, idt double, a_rev boolean, a_start int, a_end int, a_len int, b_rev boolean, b_start int, b_end int, b_len int, tag string"
PAF = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, matches int, aln_len int, mapq int"
GFF = "seq string, source string, type string, start int, end int, score string, strand string, phase string, attrs string"
SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<string>"
SEQUENCE = "name string, seq string, qual string"
