"""Word lists, patterns, thresholds and rule tables that decide results."""

# --- fixed values: page text -------------------------------------------------------------------------
SPANISH_WORDS = ["el", "la", "los", "las", "de", "en", "y", "para", "con", "por", "un", "una", "que", "es", "su",
                 "del", "se", "no", "más", "cómo", "qué"]
ENGLISH_WORDS = ["the", "and", "for", "with", "our", "your", "is", "are", "we", "you", "of", "to", "in", "at", "on"]
CALL_TO_ACTION_MARKS = ["→", "cotiza", "llama", "agenda", "compra", "$"]
BRAND_TOKENS = ["iPhone", "iPad", "iPadOS", "iPod", "iMac", "MacBook", "iOS", "macOS", "WhatsApp", "YouTube",
                "PayPal", "TikTok"]
QUESTION_MARKERS = ["por que", "que hacer", "como", "cuanto", "cuando", "donde", "cual es", "quien"]
# what text trimming removes: every character Unicode calls white space
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER_RUN = "[a-záéíóúñ]+"
READING_WORD = "[a-zA-ZáéíóúñÁÉÍÓÚÑüÜ]+"
READING_SENTENCE_END = "[.!?¡¿]+"
READING_VOWELS = "[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]+"
STUCK_WORDS = "[a-záéíóúñ][A-ZÁÉÍÓÚÑ]"
REPEATED_SUFFIX = r"(?:\s*[|·\-–—]\s*)([^|·\-–—]{2,40}?)\s*[|·\-–—]\s*\1\s*$"
BYLINE = r"\b(por|escrito por|autor|redactado por)\s*:?\s*\w+"
VISIBLE_DATE = (
    r"\b(actualizado|publicado|última actualización)\b.{0,30}(\d{4}|\d{1,2}\s+de\s+\w+)"
    r"|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d{1,2}\s+de\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b"
)
CONTACT_WORDS = r"\b(contáctanos|contacto|whatsapp|escríbenos)\b"
PHONE = r"(\+?57[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
PHONE_DIGITS = 10

# --- fixed values: page rules ------------------------------------------------------------------------
RELEVANT_SCHEMA_TYPES = ["LocalBusiness", "Service", "Product", "FAQPage", "HowTo", "Organization", "Article",
                         "BlogPosting", "BreadcrumbList", "Review", "AggregateRating"]
BLOCKING_DIRECTIVES = ["noindex", "none"]
BOT_PREFIXES = ["googlebot", "bingbot", "*"]
MIN_WORDS_CONTENT = 300
MIN_WORDS_THIN = 200
NESTED_SCHEMA_FIELDS = ["offers", "aggregateRating", "address", "geo", "author", "publisher"]
# type -> (required, recommended)
SCHEMA_FIELD_RULES = {
    "LocalBusiness": (["name", "address"],
                      ["telephone", "openingHoursSpecification", "priceRange", "geo", "url", "image", "sameAs"]),
    "Organization": (["name", "url"], ["logo", "sameAs"]),
    "Product": (["name"], ["image", "description", "brand", "sku", "offers"]),
    "FAQPage": (["mainEntity"], []),
    "BreadcrumbList": (["itemListElement"], []),
    "Article": (["headline"], ["image", "datePublished", "dateModified", "author"]),
    "BlogPosting": (["headline"], ["image", "datePublished", "dateModified", "author"]),
    "Event": (["name", "startDate", "location"], ["image", "description", "offers"]),
}
SCHEMA_FIELD_EQUIVALENTS = {"openingHoursSpecification": "openingHours", "image": "logo", "address": "location"}
HSTS_MIN_AGE = 15768000
UNSAFE_CSP_TOKENS = ["unsafe-inline", "unsafe-eval"]
# metric -> (needs improvement, poor)
VITALS_THRESHOLDS = {"lcp_ms": (2500, 4000), "cls": (0.1, 0.25), "tbt_ms": (200, 600)}

# --- fixed values: search and links ------------------------------------------------------------------
RELIABLE_CLICKS = 30
NEVER_CLICKED_IMPRESSIONS = 30
ZERO_CTR_IMPRESSIONS = 5
DECAY_MIN_DAYS = 60
DECAY_DROP = 0.30
GAP_OVERLAP = 0.34
SIGNIFICANT_WORD_LENGTH = 4
SPAM_TLDS = ["xyz", "top", "win", "loan", "click", "gq", "tk", "ml", "cf", "ga", "work", "party"]
OVER_OPTIMIZED_SHARE = 0.30
EMPTY_ANCHOR = "(sin texto / imagen)"
TOXIC_CRITICAL, TOXIC_HIGH = 0.20, 0.05
PLATFORM_DOMAINS = ["instagram.com", "facebook.com", "tiktok.com", "youtube.com", "twitter.com", "x.com",
                    "linkedin.com", "pinterest.com", "waze.com", "wikipedia.org", "reddit.com", "threads.net",
                    "whatsapp.com", "t.me", "medium.com"]
WEAK_INBOUND, DEEP_CLICKS = 1, 4
# agent, owner, access recommended
AI_AGENTS = [("GPTBot", "OpenAI", True), ("OAI-SearchBot", "OpenAI", True), ("ClaudeBot", "Anthropic", True),
             ("PerplexityBot", "Perplexity", True), ("CCBot", "Common Crawl", False)]
INTENTS = ["informacional", "comercial", "transaccional", "navegacional", "local"]

# --- fixed values: ledger ----------------------------------------------------------------------------
SEVERITIES = ["critical", "high", "medium"]
EFFORT_RANK = {"5min": 0, "30min": 1, "1h": 2, "1d": 3}
PAGE_CATEGORIES = ["meta", "h1", "schema", "og", "canonical", "index", "content", "zombie", "eeat", "decay"]
OPPORTUNITY_CATEGORIES = ["cannibalization", "pruning", "decay", "meta", "ctr"]
SITE_HEALTH_CATEGORIES = ["coverage", "internal_links", "duplicates", "schema", "performance"]
SCORE_DROP = 10
SCORE_LABELS = {"seo": "SEO", "geo": "GEO", "technical": "Technical", "content": "Content", "local": "Local"}
