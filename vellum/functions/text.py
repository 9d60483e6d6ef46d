"""Text functions as column expressions: everything here stays in the JVM.

Character counts are code points; where a threshold is in bytes the name says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges that count as CJK.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}]"
#: Unicode white space, as a Java character class.
SPACE = r"[\x09-\x0d\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A download watermark on a line of its own, or inside a sentence, and a hyphen left by a line break.
WATERMARK_LINE = r"(?im)^[ \t]*Downloaded from\b[^\n]*?\buser on\s+\d{1,2}\s+\w+\s+\d{4}\b[^\n]*\r?\n?"
WATERMARK_INLINE = r"(?i)[ \t]+Downloaded from\b[^\n]*?\buser on\s+\d{1,2}\s+\w+\s+\d{4}\b[ \t]*(?:\r?\n[ \t]*){0,2}"
BROKEN_HYPHEN = r"\b([a-z]{1,3})-[ \n]([a-z]{3,})\b"
# What may follow a lone letter, short words that are no fragments, and words that headings are made of.
COMPANIONS = "value values axis axes ray rays wave waves".split()
SHORT_WORDS = """an as at be by de do he if in is it me my no of on or so to up us we am eg ie vs are was has had not but and the
for its his her our can may use via per all any few how who why ray rays""".split()
HEADING_WORDS = """a an and are as at be by for from in into is it its of on or per the to via was were with de et al vivo vitro situ
silico novo novel new method methods approach approaches analysis analyses study studies results discussion conclusion
conclusions introduction overview review learning deep machine model models network networks system systems data based
using role effect effects mechanism mechanisms insights evidence prediction detection identification characterization
evaluation comparison between among across during their these those reveals identifies gene genes expression regulation
regulatory protein proteins cell cells cellular dna rna chromatin transcription enhancer enhancers""".split()
_MARK = "\ue000"


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


#: The characters of SPACE.
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def squeezed(text: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def whitespace_words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def cjk_count(text: Column) -> Column:
    return F.when(_ascii(text), 0).otherwise(F.regexp_count(text, F.lit(CJK)))


def alphanumerics(text: Column) -> Column:
    """Letters, digits and CJK characters."""
    return F.when(_ascii(text), F.regexp_count(text, F.lit("[0-9A-Za-z]"))).otherwise(F.regexp_count(text, F.lit(r"[\p{L}\p{N}" + CJK[1:])))


def truncated(text: Column, n: int) -> Column:
    """At most n characters: the text, a hard cut for n <= 3, else n - 3 and an ellipsis."""
    cut = F.substring(text, 1, n) if n <= 3 else F.concat(F.substring(text, 1, n - 3), F.lit("..."))
    return F.when(F.char_length(text) <= n, text).otherwise(cut)


def estimated_tokens(text: Column) -> Column:
    """A token for each CJK character, and one for every four others that are not white space."""
    cjk = cjk_count(text)
    other = F.char_length(F.regexp_replace(text, SPACE, "")) - F.regexp_count(F.regexp_replace(text, SPACE, ""), F.lit(CJK))
    return (cjk + F.ceil(other / 4)).cast("long")


def estimated_words(text: Column, cjk_per_word: int = 2) -> Column:
    """White-space words, and for text that is mostly CJK a word per ``cjk_per_word`` such characters."""
    cjk = cjk_count(text)
    n = whitespace_words(text)
    return F.when(cjk > F.floor(F.char_length(text) / 2), n + F.floor(cjk / cjk_per_word)).otherwise(n).cast("long")


def preprocessed(text: Column, fix_hyphens: bool = False) -> Column:
    """Line ends as \\n, runs of space-like characters as one space, no control characters, at most three newlines."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\t\xa0\x{2000}-\x{200b} ]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return squeezed(rejoined(t) if fix_hyphens else t)


def rejoined(text: Column) -> Column:
    """Short prefixes that a line break tore off are put back."""
    return F.regexp_replace(text, BROKEN_HYPHEN, "$1$2")


def without_watermarks(text: Column) -> Column:
    """Download watermarks removed; a text without one is untouched, and double spaces go only where one stood."""
    t = F.regexp_replace(F.regexp_replace(text, WATERMARK_LINE, ""), WATERMARK_INLINE, _MARK)
    lines = F.transform(F.split(t, "\n"), lambda x: F.when(x.contains(_MARK), F.replace(F.regexp_replace(x, " {2,}", " "), F.lit(_MARK), F.lit(" "))).otherwise(x))
    t = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.when(text.rlike(WATERMARK_LINE) | text.rlike(WATERMARK_INLINE), t).otherwise(text)


def quality_rows(text: Column, min_bytes: int = 50, min_words: int = 10, min_lines: int = 2, min_alnum: float = 0.40, reject: int = 30, warn: int = 70) -> Column:
    """An array of one (score, issues, action) of an extracted text, for ``inline``; its length is measured in bytes.

    The text is trimmed and counted once: a lambda over an array of one element binds what an expression would repeat
    wherever it is named."""
    def measured(t: Column) -> Column:
        lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n")))
        alnum = alphanumerics(t)
        # fixed values: the issues and the points that each costs
        return F.filter(
            F.array(
                F.struct(F.lit("too_short").alias("issue"), F.lit(30).alias("points"), (F.octet_length(t) < min_bytes).alias("hit")),
                F.struct(F.lit("too_few_words").alias("issue"), F.lit(20).alias("points"), (estimated_words(t) < min_words).alias("hit")),
                F.struct(F.lit("too_few_lines").alias("issue"), F.lit(20).alias("points"), (lines < min_lines).alias("hit")),
                F.struct(F.lit("low_alphanumeric_ratio").alias("issue"), F.lit(40).alias("points"), (alnum / F.greatest(F.char_length(t), F.lit(1)) < min_alnum).alias("hit")),
            ),
            lambda x: x["hit"],
        )

    def verdict(found: Column) -> Column:
        score = F.greatest(F.lit(100) - F.aggregate(found, F.lit(0), lambda a, x: a + x["points"]), F.lit(0))
        action = F.when(score < reject, "reject").when(score < warn, "index_with_warning").otherwise("index")
        return F.struct(score.alias("score"), F.transform(found, lambda x: x["issue"]).alias("issues"), action.alias("action"))

    return F.transform(F.transform(F.transform(F.array(text), squeezed), measured), verdict)


def quality(text: Column, **limits) -> dict[str, Column]:
    """``score, issues, action`` as columns; who takes several takes ``quality_rows`` inline, which measures a text once."""
    once = quality_rows(text, **limits)
    return {k: once[0][k] for k in ("score", "issues", "action")}


def deduplicated(values: Column) -> Column:
    """Trimmed strings without empty ones, the word null, and later spellings of one already there."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "null"))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def string_or_array(value: Column) -> Column:
    """Parts of a text: at commas, else at semicolons, else the text alone; trimmed, none empty."""
    parts = F.split(value, F.when(value.contains(","), F.lit(",")).otherwise(F.lit(";")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def normalised(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    t = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{SPACE[1:]}", "")
    return F.trim(F.regexp_replace(t, rf"{SPACE}+", " "))


def stripped_figure_prefix(caption: Column) -> Column:
    """A caption without its leading figure label."""
    # fixed value: the words of a figure label
    return F.regexp_replace(F.ltrim(caption), r"(?i)^(?:supplementary figure |figure |fig\. )[a-z0-9_]+[.: ]*", "")


def caption_needle(caption: Column, n: int = 130) -> Column:
    """The whole words at the start of a caption that make up n bytes, normalised."""
    t = F.trim(F.regexp_replace(stripped_figure_prefix(caption), f"{SPACE}+", " "))
    # a word takes its bytes and one for its space, so one that n characters cut is not among them
    words = F.split(F.substring(t, 1, n), " ")
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("words"))

    def step(a, w):
        upto = a["bytes"] + F.octet_length(w) + 1
        return F.struct(upto.alias("bytes"), (a["words"] + F.when(upto <= n, 1).otherwise(0)).alias("words"))

    return normalised(F.array_join(F.slice(words, F.lit(1), F.aggregate(words, start, step)["words"]), " "))


def ngrams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams; none of a shorter text."""
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containment(needle: Column, hay: Column, n: int = 4) -> Column:
    """Share of needle's n-grams that hay has; of fewer than three words, whether hay contains it."""

    def of(x):
        a, needle, hay = x["grams"], x["needle"], x["hay"]
        # a text has an n-gram exactly if it contains it, so the n-grams of a long text are never made
        share = F.size(F.filter(a, lambda g: hay.contains(g))) / F.size(a)
        short = F.size(F.split(F.trim(needle), r"\s+")) < 3
        return F.when(short | (F.size(a) == 0), F.when(hay.contains(needle) & (needle != ""), 1.0).otherwise(0.0)).otherwise(share)

    # a lambda over one element binds the text, which an expression would compute for each n-gram
    return F.transform(F.array(F.struct(ngrams(needle, n).alias("grams"), needle.alias("needle"), hay.alias("hay"))), of)[0]


def plausible_title(title: Column, least: int = 5) -> Column:
    """Long enough, with at least two letters or digits that make up a tenth of it."""
    t = F.trim(title)
    meaningful = alphanumerics(t)
    return (F.char_length(t) >= least) & (meaningful >= 2) & (meaningful * 10 >= F.char_length(t))


def _neighbours(words: Column, test) -> Column:
    """Whether test holds for some word and the one after it."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), test), lambda x: x)


def artifacts_likely(text: Column) -> Column:
    """Traces of spaces inside words: a lone lower-case letter that is no symbol beside its companion, or a fragment of two
    or three bytes beside a longer lower-case word."""
    w = F.split(squeezed(text), f"{SPACE}+")
    companion = lambda y: y.rlike(r"^[=<>0-9]") | F.lower(F.regexp_replace(y, r"\p{Punct}+$", "")).isin(COMPANIONS)
    lone = lambda x: x.rlike("^[b-hj-z]$")
    fragment = lambda x, y: x.rlike(r"^\p{L}+$") & F.octet_length(x).between(2, 3) & ~F.lower(x).isin(SHORT_WORDS) & y.rlike(r"^\p{Ll}\p{L}{4,}$")
    last = lone(F.element_at(w, -1))
    return last | _neighbours(w, lambda x, y: (lone(x) & ~companion(y)) | fragment(x, y) | fragment(y, x))


def heading_split_likely(title: Column, known: list[str] | None = None) -> Column:
    """The same for headings, where two longer words in a row count too unless one is known."""
    known = list(known or HEADING_WORDS)
    w = F.split(squeezed(title), f"{SPACE}+")
    long_ = lambda x: x.rlike("^[a-z][A-Za-z-]{3,}$")
    short = lambda x: x.rlike("^[A-Za-z]{2,3}$") & ~F.lower(x).isin(known)
    half = lambda x: x.rlike("^[a-z][A-Za-z]{3,}$") & ~F.lower(x).isin(known)
    return F.exists(w, lambda x: x.rlike("^[b-hj-z]$")) | _neighbours(w, lambda x, y: (short(x) & long_(y)) | (short(y) & long_(x)) | (half(x) & half(y)))


def same_but_spaces(a: Column, b: Column) -> Column:
    """Whether a correction changed nothing but white space."""
    return F.regexp_replace(a, SPACE, "") == F.regexp_replace(b, SPACE, "")


def sanitised_label(label: Column) -> Column:
    """A figure label for file names and ids: runs of other characters than letters, digits and hyphens as one underscore,
    none at the ends."""
    return F.btrim(F.regexp_replace(label, "[^A-Za-z0-9-]+", "_"), F.lit("_"))


def markdown_images(text: Column, paper_id: Column) -> Column:
    """Images of a Markdown text in order: (id, caption, path)."""
    # fixed value: what an image looks like in Markdown
    pattern = F.lit(r"!\[(.*?)\]\((.*?)\)")
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("caption"), F.regexp_extract_all(text, pattern, 2).alias("path")), lambda x, i: F.struct(F.concat(paper_id, F.lit("_fig"), (i + 1).cast("string")).alias("id"), x["caption"].alias("caption"), x["path"].alias("path")))


def safe_paper_id(value: Column) -> Column:
    """An id that cannot leave its folder: not empty, without separators and two dots."""
    return (value != "") & ~value.rlike(r"\.\.|[/\\]")


def safe_file_name(value: Column) -> Column:
    """Characters that file systems refuse as underscores; at most 100 characters."""
    return F.substring(F.translate(value, ' /\\:*?"<>|', "_" * 10), 1, 100)


def csv_field(value: Column) -> Column:
    """Quoted where a comma, a quote or a line end asks for it."""
    return F.when(value.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def publication_year(date: Column) -> Column:
    """The first four characters as a number; null if they are none."""
    return F.when(date.rlike(r"^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))


def formatted_date(date: Column) -> Column:
    """A year, or a year with one or two more numbers, as it stands; null if it is none."""
    t = squeezed(date)
    return F.when(t.rlike(r"^[0-9]{4}(-[0-9]+){0,2}$"), t)


def year_string(date: Column) -> Column:
    """What stands before the first hyphen of a date; null if that is empty."""
    return F.nullif(F.split_part(squeezed(date), F.lit("-"), F.lit(1)), F.lit(""))


def short_authors(authors: Column, n: int = 3) -> Column:
    """The first names and, of more, an abbreviation."""
    return F.array_join(F.concat(F.slice(authors, 1, n), F.when(F.size(authors) > n, F.array(F.lit("et al."))).otherwise(F.array().cast("array<string>"))), ", ")


def head_hash(content: Column, n: int = 8192) -> Column:
    """SHA-256 of the first bytes of a file: a cheap sign that two may be equal, before all of them are compared."""
    return F.sha2(F.substring(content.cast("binary"), 1, n), 256)


def valid_partial_date(date: Column) -> Column:
    """A year, a month or a day that exists."""
    return date.rlike(r"^\d{4}$") | date.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") | (date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNotNull())


def image_verdict(n_bytes: Column, width: Column, height: Column, min_bytes: int = 5000, min_short: int = 100, min_long: int = 200) -> Column:
    """Why an image is too poor to keep; null if it is not."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    return F.when(n_bytes < min_bytes, F.lit("file_too_small")).when(short < min_short, F.lit("short_side_too_small")).when(long_ < min_long, F.lit("long_side_too_small"))


def truncated_to(text: Column, n: Column) -> Column:
    """``truncated`` for a length that is a column, above 3."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, F.lit(1), n - 3), F.lit("...")))


def safe_join(root: Column, part: Column) -> Column:
    """A path under root; null if the part is absolute, has two dots or a backslash."""
    bad = part.rlike(r"\.\.|\\|^/")
    return F.when(~bad, F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), part))


def input_path(path: Column, home: str | None = None) -> Column:
    """A path as a user pastes it: one pair of equal quotes around it goes, so do the backslashes that a terminal sets before
    special characters, and a tilde at the front is the home folder, where one is known."""
    t = F.regexp_replace(squeezed(path), r"(?s)^(['\"])(.*)\1$", "$2")
    # fixed value: the characters before which a terminal sets a backslash
    t = F.regexp_replace(t, r"\\([ \\'\"()\[\]{};&$!#*?<>|`])", "$1")
    return t if home is None else F.when((t == "~") | t.startswith("~/"), F.concat(F.lit(home.rstrip("/")), F.substr(t, F.lit(2)))).otherwise(t)


def url_encoded(text: Column) -> Column:
    """All bytes but letters, digits and ``-_.~`` as percent escapes."""
    t = F.url_encode(text)
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("+", "%20"), ("*", "%2A"), ("%7E", "~")), t)


def url_decoded(text: Column) -> Column:
    """Percent escapes as the UTF-8 that they stand for; null where one is broken or they are no UTF-8.  A plus stays."""
    t = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    # the decoder marks what is no UTF-8; a mark that was there or was escaped is none of its own
    marks = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    return F.when(marks(t, "\ufffd") == marks(text, "\ufffd|(?i:%EF%BF%BD)"), t)


def file_path(url: Column) -> Column:
    """The local path of a file URL; null for other schemes, other machines and broken escapes.  A drive loses the slash
    before it."""
    # fixed values: what a URL calls the machine itself
    rest = F.regexp_extract(url, r"(?s)^file://(?:localhost|127\.0\.0\.1|\[::1\])?(/.*)$", 1)
    return F.regexp_replace(url_decoded(F.when(rest != "", rest)), "^/(?=[A-Za-z]:)", "")


def normalised_path(path: Column, home: str | None = None) -> Column:
    """A pasted path or file URL as a path."""
    t = input_path(path, home)
    return F.when(t.startswith("file://"), file_path(t)).otherwise(t)


def translation_hash(text: Column) -> Column:
    """The key under which a text's translation is kept: 64 bits in hexadecimal."""
    return F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0")
