"""SQL expressions over sequences, codons and GFF attributes; each takes and gives the text of an expression."""

from __future__ import annotations

# Complements, stop codons, splice motif pairs, and what attribute values leave as it is.
IUPAC = ("ACGTRYKMBDHVSWN", "TGCAYRMKVHDBSWN")
PLAIN = ("ACGTN", "TGCAN")
STOPS = ("TAA", "TAG", "TGA")
SPLICE_PAIRS = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))
PLAIN_IN_ATTRIBUTES = ("%2B", "+"), ("%3A", ":"), ("%5E", "^"), ("%24", "$"), ("%40", "@"), ("%21", "!"), ("%3F", "?"), ("%7C", "|"), ("%7E", "~")


def reverse_complement(seq: str, alphabet: tuple[str, str] = IUPAC) -> str:
    """The other strand; letters outside `alphabet` stay as they are."""
    return f"reverse(translate({seq}, '{alphabet[0]}', '{alphabet[1]}'))"


def non_acgt(seq: str) -> str:
    return f"length(regexp_replace({seq}, '[ACGT]', ''))"


def is_stop(codon: str) -> str:
    return f"({codon} IN ({', '.join(map(repr, STOPS))}))"


def codons(seq: str) -> str:
    """Non-overlapping triplets; a rest of one or two bases is dropped."""
    return f"regexp_extract_all({seq}, '...', 0)"


def base_code(base: str) -> str:
    """A, C, G, T and anything else as 0 to 4."""
    return f"(CASE instr('ACGT', {base}) WHEN 0 THEN 4 ELSE instr('ACGT', {base}) - 1 END)"


def supported_splice(donor: str, acceptor: str) -> str:
    return "(" + " OR ".join(f"({donor} = '{d}' AND {acceptor} = '{a}')" for d, a in SPLICE_PAIRS) + ")"


def escape_attribute(value: str) -> str:
    """Percent codes for all but letters, digits and . _ - * + : ^ $ @ ! ? | ~"""
    value = f"replace(url_encode({value}), '+', '%20')"
    for code, plain in PLAIN_IN_ATTRIBUTES:
        value = f"replace({value}, '{code}', '{plain}')"
    return value


def decoded(value: str, within: str | None = None) -> str:
    """Percent codes undone; a plus stays, and so does a value with a malformed code. `value` is part of `within`, if given."""
    return f"CASE WHEN instr({within or value}, '%') = 0 THEN {value} ELSE coalesce(try_url_decode(replace({value}, '+', '%2B')), {value}) END"


def attributes(text: str) -> str:
    """The map of a GFF3 or GTF attribute column. Parts are key=value, key "value" or a flag; the last of a repeated key wins; '.' is empty."""
    key = "CASE WHEN instr(p, '=') > 0 THEN trim(substring_index(p, '=', 1)) WHEN instr(p, ' ') > 0 THEN substring_index(p, ' ', 1) ELSE p END"
    value = """CASE WHEN instr(p, '=') > 0 THEN trim(substr(p, instr(p, '=') + 1)) WHEN instr(p, ' ') > 0 THEN trim(BOTH chr(34) FROM trim(substr(p, instr(p, ' ') + 1))) ELSE '' END"""
    key, value = decoded(key, "p"), decoded(value, "p")
    keys, values = f"transform(ps, p -> {key})", f"transform(ps, p -> {value})"
    last = f"map_from_entries(aggregate(transform(ps, p -> struct({key} AS k, {value} AS v)), cast(array() as array<struct<k:string,v:string>>), (a, e) -> concat(filter(a, x -> x.k <> e.k), array(e))))"
    parts = f"filter(transform(split({text}, ';'), p -> trim(p)), p -> p <> '' AND p <> '.')"
    return f"get(transform(array({parts}), ps -> CASE WHEN size(ps) < 2 OR size(array_distinct({keys})) = size(ps) THEN map_from_arrays({keys}, {values}) ELSE {last} END), 0)"


def ceil_div(a: str, b: str) -> str:
    return f"(({a} + {b} - 1) div {b})"


def aligned(x: str, step: int = 50) -> str:
    """The nearest multiple of `step`, halves up."""
    return f"(({x} + {step // 2}) div {step} * {step})"


def readable_bytes(n: str) -> str:
    """Binary units with two decimals."""
    cases = " ".join(f"WHEN {n} >= {1024**k} THEN format_string('%.2f {u}', {n} / {float(1024**k)}D)" for k, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")))
    return f"(CASE {cases} ELSE format_string('%.2f B', cast({n} as double)) END)"


def first_phase(before: str) -> str:
    """GFF phase of a block after `before` coding bases."""
    return f"((3 - {before} % 3) % 3)"


def group_name(name: str) -> str:
    """A name that is safe in paths and can be turned back: percent codes for all but letters, digits and _ . - ~"""
    return f"replace(replace(replace(url_encode({name}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def clean_cell(text: str) -> str:
    """A text for one cell of a tab-separated line: without line ends, tabs as spaces."""
    return f"translate({text}, '\\t\\n', ' ')"
