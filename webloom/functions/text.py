"""Text expressions: cleaning, token budgets, product text and error classes."""

from __future__ import annotations

from collections.abc import Iterable

from webloom.functions.sql import any_of, bind, strip, text

# What is cut from raw HTML, in this order, before it is parsed.
IRRELEVANT_HTML = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"(?is)<meta[^>]*>",
    r"(?is)<link[^>]*>",
    r"(?is)<noscript[^>]*>.*?</noscript>",
    r"(?is)<iframe[^>]*>.*?</iframe>",
)
# A text chunk with one of these words is likely to show products.
PRODUCT_INDICATORS = ("$", "price", "buy", "add to cart", ".95", ".99", "product")
PRODUCT_FILE_INDICATORS = (*PRODUCT_INDICATORS, "item")
# A link with one of these words is likely to lead to products.
PRODUCT_URL_WORDS = ("product", "item", "detail", "p/", "/p/", "catalog", "shop", "buy", "purchase", "goods",
                     "merchandise", "listing")
# Product lines in running text, and labels that are not part of a name.
PRODUCT_LINE = r"-\s*(.+?)\$(\d+(?:\.\d{2})?(?:\s*-\s*\$\d+(?:\.\d{2})?)?)"
NAME_LABELS = r"(Top Rated|Save \d+%)"
PRICE_TEXT = r"\$\d+\.\d{2}"

CHARS_PER_TOKEN = 4
DEFAULT_TOKEN_BUDGET = 20_000


def strip_irrelevant_html(html: str) -> str:
    """Raw HTML without scripts, styles, comments, meta and link tags, noscript and iframe elements."""
    for pattern in IRRELEVANT_HTML:
        html = f"regexp_replace({html}, {text(pattern)}, '')"
    return html


def tokens_for(chars: str) -> str:
    return f"ceil(({chars}) / {CHARS_PER_TOKEN})"


def count_tokens(value: str) -> str:
    """Approximate token count, four characters to a token."""
    return tokens_for(f"length({value})")


def truncate_budget(html: str, max_tokens: int = DEFAULT_TOKEN_BUDGET) -> str:
    """Cut what is over budget at four characters per token and mark the cut with an ellipsis."""
    return bind(html, "h", f"if({count_tokens('h')} > {max_tokens}, "
                           f"concat(substring(h, 1, {CHARS_PER_TOKEN * max_tokens}), '...'), h)")


def field_keywords(fields: str) -> str:
    """Search words of target fields: lower-cased, with ``-`` and ``_`` exchanged, and their longer parts."""
    return (f"array_distinct(flatten(transform({fields}, f -> concat("
            "array(lower(f), replace(lower(f), '_', '-'), replace(lower(f), '-', '_')), "
            "filter(split(lower(f), '_'), w -> length(w) > 2)))))")


def contains_any(value: str, words: Iterable[str]) -> str:
    """True where the lower-cased text contains one of the words."""
    return bind(f"lower({value})", "low", any_of(f"contains(low, {text(w)})" for w in words))


def contains_any_of(value: str, words: str) -> str:
    """``contains_any`` for an array column of words."""
    return bind(f"lower({value})", "low", f"exists({words}, w -> contains(low, w))")


def clean_product_name(name: str, labels: str = NAME_LABELS) -> str:
    """A product name without labels; ``labels`` is the pattern of what a shop writes into its names."""
    return strip(f"regexp_replace({name}, {text(labels)}, '')")


def product_price(amount: str) -> str:
    return f"concat('$', {amount})"


def product_matches(value: str) -> str:
    """Array of (name, price) for every ``- name $price`` in the text, in order.

    ``(?d)`` lets a dot match a carriage return and ``(?U)`` widens digits and spaces to Unicode.
    """
    pattern = text("(?dU)" + PRODUCT_LINE)
    return (f"zip_with(regexp_extract_all({value}, {pattern}, 1), regexp_extract_all({value}, {pattern}, 2), "
            f"(n, a) -> named_struct('name', {clean_product_name('n')}, 'price', {product_price('a')}))")


def unfenced(answer: str) -> str:
    """The inside of the first code fence of a model's answer, the whole answer where it has none."""
    fenced = text(r"(?s)```(?:json|JSON)?\s*(.*?)\s*```")
    return f"if({answer} RLIKE {fenced}, regexp_extract({answer}, {fenced}, 1), {answer})"


def classify_error(message: str) -> str:
    """Class of a failed request; the first rule that holds decides."""
    return (f"CASE WHEN {message} LIKE '%403%' OR {message} LIKE '%Access Denied%' THEN 'access_denied' "
            f"WHEN lower({message}) LIKE '%timeout%' OR {message} LIKE '%ReadTimeoutError%' THEN 'timeout' "
            f"WHEN {message} IS NOT NULL THEN 'other' END")


def collapse_lines(value: str) -> str:
    """One line: every line trimmed, empty ones dropped, the rest joined by a space."""
    return f"array_join(filter(transform(split({value}, '\\n'), line -> {strip('line')}), line -> line <> ''), ' ')"
