"""Text and hashing functions on columns: built-ins, but for the Unicode forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in alias phrases and queries.
PHRASE_STOP_WORDS = (
    "a an the and or nor not no is are was were be been being am do does did done of in on at to for with from by as into onto over under "
    "after before against between during without within about above below out off up down again further it its this that these those there "
    "here so such both each few more most other some own same too very than then when where which who whom whose why how what while can could "
    "should would may might must will shall have has had having we our ours you your yours i he she they them their his her also just only "
    "ever never per via"
).split()
# Name and pattern of text that tries to steer a reader.
INJECTION_SIGNALS = {
    "instruction_override": r"(?is)\b(?:ignore|disregard|forget|override)\b.{0,60}?\b(?:previous|prior|above|earlier|all|any|system)\b.{0,60}?\b(?:instructions?|prompts?|rules?|directives?|policies)\b",
    "role_reassignment": r"(?i)new\s+system\s+prompt|you\s+are\s+now\b|act\s+as\s+(?:the\s+)?(?:system|admin)",
    "system_role_marker": r"(?im)^\s*(?:system|assistant|developer)\s*:",
    "chat_template_token": r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[INST\]|<<SYS>>",
    "secret_exfiltration": r"(?is)\b(?:reveal|print|show|output|leak|exfiltrate|repeat)\b.{0,60}?\b(?:system\s+prompt|secrets?|credentials?|api\s+keys?|passwords?|tokens?)\b",
    "unicode_obfuscation": "[\u202a-\u202e\u2066-\u2069\u200b-\u200f\ufeff]",
}


def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _plain(c: pd.Series) -> pd.Series:
    return c.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return F.pandas_udf(_composed, "string")(c)


def ascii_form(c: Column) -> Column:
    """Compatibility decomposition, without what isn't ASCII then."""
    return F.pandas_udf(_plain, "string")(c)


def normalize_text(c: Column) -> Column:
    """Canonical composition, line feeds only, no space at line ends, no blank lines around, one line feed at the end; empty stays empty."""
    c = F.regexp_replace(F.regexp_replace(nfc(c), "\r\n?", "\n"), "[ \t\x0b\f]+(?=\n|$)", "")
    c = F.regexp_replace(F.regexp_replace(c, "^\n+", ""), "\n+$", "")
    return F.when(c == "", "").otherwise(F.concat(c, F.lit("\n")))


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256)


def hash_embedding(c: Column) -> Column:
    """Eight numbers in [0, 1]: the eight-digit groups of the text's hash over their largest value."""
    h = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0))


def normalize_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-case ASCII tokens of at least ``least`` characters, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def normalize_phrase(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(PHRASE_STOP_WORDS)), " ")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def readable_path(uri: Column) -> Column:
    """The path of an item: behind owner and repository where the address names them."""
    rest = F.regexp_replace(uri, "^[a-z]+://", "")
    return F.when(uri.startswith("github://"), F.regexp_replace(rest, "^[^/]*/[^/]*/", "")).otherwise(rest)


def card_summary(body: Column, limit: int = 280) -> Column:
    """The first line of the body without white space around it."""
    bare = F.regexp_replace(F.coalesce(body, F.lit("")), "^[ \t\r\n\x0b\f]+|[ \t\r\n\x0b\f]+$", "")
    return F.substring(F.element_at(F.split(bare, "\r\n|\r|\n"), 1), 1, limit)


def snippet(body: Column, search_text: Column, limit: int = 200) -> Column:
    flat = lambda c: F.trim(F.regexp_replace(c, "[ \t\r\n]+", " "))
    return F.substring(F.coalesce(F.nullif(flat(body), F.lit("")), flat(search_text), F.lit("")), 1, limit)


def scan_injection(*cs: Column) -> Column:
    """Names of the signals that any of the columns shows, in the table's order."""
    hit = lambda p: F.greatest(*(F.coalesce(c.rlike(p), F.lit(False)) for c in cs)) if len(cs) > 1 else F.coalesce(cs[0].rlike(p), F.lit(False))
    return F.array_compact(F.array(*(F.when(hit(p), F.lit(n)) for n, p in INJECTION_SIGNALS.items())))


def split_identifier(c: Column) -> Column:
    """camelCase and snake_case to lower-case words."""
    c = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def phrase_variants(phrase: Column) -> Column:
    many = F.instr(phrase, " ") > 0
    return F.when(many, F.array(F.replace(phrase, F.lit(" "), F.lit("-")), F.replace(phrase, F.lit(" "), F.lit("_")))).otherwise(F.array().cast("array<string>"))


# Explicit forms of a work item's number; a bare number is none.
WORK_ITEM_FORMS = (r"AB#([0-9]+)", r"GH-([0-9]+)", r"(?i)PR\s*#([0-9]+)", r"(?<![\w#-])#([0-9]+)")
BRANCH_FORMS = (r"AB-([0-9]+)", r"GH-([0-9]+)", r"(?<=/)([0-9]+)(?=[-_/]|$)", r"^([0-9]+)(?=[-_/]|$)")


def work_item_matches(c: Column, branch: Column | None = None) -> Column:
    """Structs (key, matched) of the work items that a text or a branch names, form by form; the first match of a key stays."""
    pairs = lambda t, p: F.zip_with(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda k, m: F.struct(k.alias("key"), m.alias("matched")))
    found = [pairs(c, p) for p in WORK_ITEM_FORMS]
    if branch is not None:
        found += [pairs(F.coalesce(branch, F.lit("")), p) for p in BRANCH_FORMS]
    every = F.concat(*found)
    keys = F.array_distinct(F.transform(every, lambda x: x["key"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(every, lambda x: x["key"] == k), 1))


def work_item_refs(c: Column, branch: Column | None = None) -> Column:
    """Numbers of work items that a text or a branch names, form by form, each once."""
    return F.transform(work_item_matches(c, branch), lambda x: x["key"])


def sha_refs(c: Column) -> Column:
    """Abbreviated commit ids: 7 to 40 hex digits between word borders with a letter among them, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("\\b([0-9a-f]{7,40})\\b"), F.lit(1)), lambda h: h.rlike("[a-f]")))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \t\r\n\x0b\f]+", " "))


def quote_grounded(quote: Column, span: Column) -> Column:
    """The quote, white space collapsed, stands in the span likewise; an empty quote never does."""
    q = collapsed(quote)
    return F.coalesce((q != "") & F.contains(collapsed(span), q), F.lit(False))


def entailment_key(claim: Column, evidence: Column) -> Column:
    return F.concat_ws(":", F.sha2(collapsed(claim), 256), F.sha2(F.array_join(F.array_sort(evidence), ","), 256))


def phrase_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Runs of 2 to 4 tokens not broken by a stop word."""
    runs = F.split(F.array_join(F.transform(tokens(c), lambda t: F.when(t.isin(PHRASE_STOP_WORDS), "|").otherwise(t)), " "), "\\|")
    words = F.transform(runs, lambda r: F.filter(F.split(r, " "), lambda w: w != ""))
    sized = lambda n: F.flatten(F.transform(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(*(sized(n) for n in range(low, high + 1))))


# Leading words of a subject that are types of change, not scopes, and the form of a label.
CHANGE_TYPES = ("build", "chore", "ci", "docs", "feat", "fix", "perf", "refactor", "revert", "style", "test")
_SUBJECT = r"^\s*([A-Za-z][\w./-]*)(?:\(([^)]*)\))?!?:\s*(.+)$"


def subject_scope(subject: Column) -> Column:
    """The scope that a subject's label names: what its parentheses hold, else the label if it is no type of change."""
    lead, scope = F.regexp_extract(subject, _SUBJECT, 1), F.regexp_extract(subject, _SUBJECT, 2)
    label = F.when(F.lower(lead).isin(*CHANGE_TYPES), F.lit(None)).otherwise(lead)
    return F.when(lead == "", F.lit(None)).otherwise(F.coalesce(F.nullif(scope, F.lit("")), label))


def subject_description(subject: Column) -> Column:
    return F.trim(F.when(F.regexp_extract(subject, _SUBJECT, 1) == "", subject).otherwise(F.regexp_extract(subject, _SUBJECT, 3)))


def doc_slug_phrase(path: Column) -> Column:
    """The phrase that a markdown file's name makes, null below two tokens: leading numbers, pr and adr go, as do stop words."""
    name = F.substring_index(path, "/", -1)
    t = tokens(F.regexp_replace(name, "(?i)\\.md$", ""))
    plain = F.transform(t, lambda x: x.rlike("^([0-9]+|pr|adr)$"))
    lead = F.array_position(plain, False)
    rest = F.filter(F.when(lead > 0, F.slice(t, lead.cast("int"), F.size(t))).otherwise(F.array().cast("array<string>")), lambda x: ~x.isin(PHRASE_STOP_WORDS))
    return F.when(name.rlike("(?i)\\.md$") & (F.size(rest) >= 2), F.array_join(rest, " "))


def is_test_file(path: Column) -> Column:
    """Below a tests folder, or named test_..."""
    return F.contains(F.concat(F.lit("/"), path), F.lit("/tests/")) | F.startswith(F.substring_index(path, "/", -1), F.lit("test_"))


def is_test_path(path: Column) -> Column:
    """The wider form: a folder that begins with test, or a file named test_... or ..._test.py."""
    name = F.substring_index(path, "/", -1)
    return F.contains(path, F.lit("/test")) | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))


def service_scope(path: Column) -> Column:
    """``services/<name>`` of a path, null without one."""
    return F.nullif(F.regexp_extract(path, "(?:^|/)(services/[^/]+)/", 1), F.lit(""))


CHANGED_FILES_HEADER = "--- changed files ---"  # fixed value: it stands in stored commit texts


def render_commit(subject: Column, body: Column, changed_files: Column) -> Column:
    """Subject, body and the sorted list of changed files, empty parts left out."""
    files = F.array_join(F.concat(F.array(F.lit(CHANGED_FILES_HEADER)), F.array_sort(F.array_distinct(changed_files))), "\n")
    parts = F.filter(F.array(F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")), files), lambda p: p != "")
    return normalize_text(F.array_join(parts, "\n\n"))


def parse_changed_files(c: Column) -> Column:
    """The paths below the last header line: a message that holds such a line itself changes nothing."""
    lines = F.transform(F.split(c, "\r\n|\r|\n"), lambda x: F.trim(x))
    back = F.array_position(F.reverse(lines), CHANGED_FILES_HEADER)
    none = F.array().cast("array<string>")
    return F.when(back > 1, F.filter(F.slice(lines, F.size(lines) - back.cast("int") + 2, F.size(lines)), lambda x: x != "")).otherwise(none)


PRIORITY_FIELDS = ("System.Title", "System.State", "System.WorkItemType", "System.AreaPath")  # fixed values


def render_work_item(item_id: Column, fields: Column) -> Column:
    """A work item's fields (a map of strings) as lines: four of them first, the rest by name; null is empty."""
    line = lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at(fields, k), F.lit("")))
    first = F.array_compact(F.array(*(F.when(F.map_contains_key(fields, k), line(F.lit(k))) for k in PRIORITY_FIELDS)))
    rest = F.transform(F.filter(F.array_sort(F.map_keys(fields)), lambda k: ~k.isin(*PRIORITY_FIELDS)), line)
    return F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("WorkItem: "), item_id.cast("string"))), first, rest), "\n"), F.lit("\n"))


def referenced_symbols(c: Column) -> Column:
    """Names of two characters or more in backticks, and the last part of dotted ones."""
    # Fixed pattern: a name in backticks.
    names = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("`([A-Za-z_][A-Za-z0-9_.]*)`"), F.lit(1)), lambda n: F.length(n) >= 2)
    tails = F.filter(F.transform(F.filter(names, lambda n: F.contains(n, F.lit("."))), lambda n: F.substring_index(n, ".", -1)), lambda n: F.length(n) >= 2)
    return F.array_distinct(F.concat(names, tails))


def display_citation(uri: Column, title: Column, artifact_type: Column, artifact_id: Column) -> Column:
    """path:title for symbols and endpoints; else the path, the title or the id, the first that isn't empty."""
    path, name = readable_path(uri), F.trim(F.coalesce(title, F.lit("")))
    symbol = artifact_type.isin("code_symbol", "endpoint") & (name != "")
    plain = F.coalesce(F.nullif(path, F.lit("")), F.nullif(name, F.lit("")), artifact_id)
    return F.when(symbol & (path != ""), F.concat(path, F.lit(":"), name)).when(symbol, name).otherwise(plain)


def symbol_search_text(*parts: Column) -> Column:
    """The different words of names, signatures and comments, sorted: what keyword search sees of a symbol."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(split_identifier(F.coalesce(p, F.lit(""))) for p in parts)))), " ")


def slugify(c: Column, fallback: Column, limit: int = 80) -> Column:
    """ASCII letters and digits of the decomposed text in lower case, other runs as one hyphen."""
    s = F.regexp_replace(F.lower(ascii_form(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, limit), "-+$", "")
    return F.when(s == "", fallback).otherwise(s)
