"""Which of two readings of the language applies where its documents and its observed behaviour differ."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantics:
    """The default is the documented reading; ``OBSERVED`` follows what programs have been seen to do."""

    #: OR and NOT mean what they say; else all conditions are applied one after the other and NOT is ignored.
    boolean_logic: bool = True
    #: An alias names the filtered set; else the set before WHERE.
    alias_after_where: bool = True
    #: WHERE applies to FIND and SCAN without an alias too.
    filter_unnamed: bool = True
    #: 1.5 KB is 1500 bases; else the number is cut to 1 before its unit applies.
    fractional_units: bool = True
    #: CHR restricts a FIND to that sequence.
    apply_chr: bool = True
    #: Every record of a FASTA file counts and sequences are matched with regions by name; else only the first
    #: record counts, for all regions.
    all_records: bool = True
    #: THRESHOLD 0 keeps every window; else it means the default of 75.
    zero_threshold: bool = True
    #: A palindrome is told after upper-casing; else a lower-case one is found on both strands.
    fold_palindromes: bool = True
    #: Contexts are cut from the forward strand; else those of regular expressions on the minus strand are
    #: reverse complements.
    forward_context: bool = True
    #: UNION cuts merged rows' sequences anew; else they keep their first member's.
    reslice_union: bool = True
    #: GFF3 columns are split at tabs and attributes are keys; else at white space and by substring.
    strict_gff: bool = True
    #: A bad regular expression is an error; else it matches nothing.
    regex_errors: bool = True
    #: An alias of the wrong kind is an error; else it names a feature type.
    check_kinds: bool = True
    #: LENGTH compared with a string is an error; else the string counts as 0.
    string_length_errors: bool = True
    #: Without the target name's feature a FIND falls back to all features; else it finds nothing.
    fallback_target: bool = True


DOCUMENTED = Semantics()
OBSERVED = Semantics(
    boolean_logic=False,
    alias_after_where=False,
    filter_unnamed=False,
    fractional_units=False,
    apply_chr=False,
    all_records=False,
    zero_threshold=False,
    fold_palindromes=False,
    forward_context=False,
    reslice_union=False,
    strict_gff=False,
    regex_errors=False,
    check_kinds=False,
    string_length_errors=False,
)
PROFILES = {"documented": DOCUMENTED, "observed": OBSERVED}
