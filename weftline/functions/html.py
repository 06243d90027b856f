"""Signals from raw HTML: is there readable text, does the page need JavaScript, was the visit blocked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import Detection

# Patterns and phrases.
SCRIPT = r"(?i)<script[\s>]"
NOSCRIPT = r"(?i)<noscript[^>]*>([^\n]*?)</noscript>"
NOSCRIPT_PHRASES = ["enable javascript", "requires javascript", "javascript is required", "javascript must be enabled", "please enable javascript", "you need to enable javascript"]
EMPTY_ROOT = r"""(?i)<div\s+id=["'](root|app|__next)["']\s*>\s*</div>"""
FRAMEWORKS = [("__NEXT_DATA__", "nextjs"), ("__NUXT__", "nuxt"), ("___gatsby", "gatsby")]
FORBIDDEN = r"(?i)<title>\s*(403|forbidden|access denied|blocked)\s*</title>"
CLOUDFLARE = r"(?i)(cloudflare|cf-chl-bypass|ray\s*id|checking your browser)"
CAPTCHA = r"(?i)(captcha|recaptcha|hcaptcha|challenge-form)"
THIN_TEXT = 200


def visible_text(html: Column) -> Column:
    """All tags as spaces, white space (Unicode) collapsed; bodies of scripts and styles count as text."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"(?U)\s+", " "))


def content_assessment(html: Column, limits: Detection | None = None) -> Column:
    """STRUCT of the signals and the verdict."""
    limits = limits or Detection()
    length = F.octet_length(visible_text(html)).cast("int")
    size = F.octet_length(html)
    ratio = F.when(size > 0, length / size).otherwise(F.lit(0.0))
    scripts = F.regexp_count(html, F.lit(SCRIPT)).cast("int")
    empty_root = html.rlike(EMPTY_ROOT)
    notices = F.transform(F.regexp_extract_all(html, F.lit(NOSCRIPT), F.lit(1)), F.lower)
    noscript = F.exists(notices, lambda x: x.rlike("|".join(NOSCRIPT_PHRASES)))
    framework = F.lit("")
    for marker, name in reversed(FRAMEWORKS):
        framework = F.when(F.contains(html, F.lit(marker)), F.lit(name)).otherwise(framework)
    needs = ((length < THIN_TEXT) & (scripts > limits.max_script_tags)) | empty_root | noscript | ((ratio < limits.min_text_ratio) & (length < limits.min_text_length))
    return F.struct(
        (length >= limits.min_text_length).alias("has_substantial_text"), length.alias("text_length"), ratio.alias("text_ratio"),
        noscript.alias("has_noscript_warning"), empty_root.alias("has_empty_root"), scripts.alias("script_tags"), framework.alias("ssr_framework"), needs.alias("needs_js"),
    )


def bot_signal(html: Column) -> Column:
    """Why a rendered page counts as blocked: 403, cloudflare, captcha, or empty."""
    return F.when(html.rlike(FORBIDDEN), "403").when(html.rlike(CLOUDFLARE), "cloudflare").when(html.rlike(CAPTCHA), "captcha").otherwise("")
