"""Values that the results depend on: patterns, lists, tables and constants."""

from __future__ import annotations

# Marker patterns of the text genres, counted without regard to case.
DEFINITION = r"\b(is defined as|refers to|is a type of|means that|is the process of|stands for|is an? [a-z]+ that|known as|terminology|glossary|what is\b|definition of|in other words|that is to say)\b"
COMPARISON = r"\b(compared (?:to|with)|versus|vs\.?|in contrast|whereas|the difference between|better than|worse than|alternative to|pros and cons|advantages? and disadvantages?|trade-?offs?|unlike|rather than|outperforms?)\b"
HOWTO = r"\b(step \d|first,|second,|third,|next,|finally,|how to|in order to|follow these|procedure|instructions|you (?:can|should|need to|must)|begin by|start by)\b"
NUMERIC = r"(\d+(?:\.\d+)?\s?%|[$£€¥]\s?\d|\b\d{1,3}(?:,\d{3})+\b|\b\d+\.\d+\b|\b\d{2,}\b\s*(?:users|customers|percent|million|billion|thousand|years|hours|days|ms|kg|km|mb|gb|x\b))"
CODE = r"(```|\bfunction\s*\(|\bclass\s+\w+|=>|\bimport\s+\w+|\bdef\s+\w+|</?[a-z]+>|\$\s?(?:npm|pip|yarn|curl|git)\s|\{\s*\"\w+\"\s*:)"
QA = r"(\bq(?:uestion)?\s*[:.\)]\s|\ba(?:nswer)?\s*[:.\)]\s|(?:what|why|how|when|where|who|can|does|do|is|are|should|will)\b[^.\n?]{0,90}\?)"
CITATION = r"\b(according to|source:|cited (?:by|in)|reported by|study (?:by|from)|research (?:by|from)|\[\d+\]|et al\.)\b"
HEDGE = r"\b(may|might|could|possibly|perhaps|arguably|it seems|industry-leading|world-class|best-in-class|cutting-edge|revolutionary|game-chang\w+|seamless|synerg\w+)\b"
PRICE = r"([$£€¥]\s?\d|\b\d[\d,.]*\s?(?:usd|eur|gbp|inr|jpy|cny|aud|cad)\b|\brs\.?\s?\d|\b\d[\d,.]*\s?(?:per|a)\s+(?:month|year|user|seat|day|hour)\b|\b(?:pricing|price|cost|fee|starting at|from)\b[^.]{0,24}[$£€¥]\s?\d)"
DATED = (
    r"\b(?:(?:updated|published|revised|reviewed|last modified|as of|effective)\s+(?:on\s+)?(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{4}|"
    r"(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b|"
    r"(?:updated|published|revised|reviewed|as of|effective)\s+(?:19|20)\d{2}\b|\bq[1-4]\s+(?:19|20)\d{2}\b|\b(?:19|20)\d{2}\s+(?:edition|report|survey|study)\b)"
)
GENRES = {
    "definition": (DEFINITION, 2), "comparison": (COMPARISON, 2), "howto": (HOWTO, 3), "numeric": (NUMERIC, 3), "code": (CODE, 2), "qa": (QA, 3),
    "citation": (CITATION, 1), "price": (PRICE, 2), "dated": (DATED, 1),
}
POSITIVE_GENRES, SURVEY_GENRES = ("definition", "comparison", "howto", "numeric", "code"), ("price", "dated")

# Word bins (low, high, mean influence), quartile bounds, score weights and targets.
WORD_BINS = ((0, 100, 0.055), (101, 300, 0.085), (301, 600, 0.113), (601, 1000, 0.112), (1001, 3000, 0.126), (3001, 10**9, 0.146))
QUARTILES = {"word_count": (169.82, 1943.30), "heading_count": (0.85, 10.59), "paragraph_count": (8.34, 47.49), "list_density": (0.048, 0.428)}
SCORE_WEIGHTS = {"words": 0.2160, "headings": 0.2084, "definition": 0.1987, "numeric": 0.1890, "comparison": 0.1879}
WORD_TARGET, HEADING_TARGET = 1943.30, 10.59
GRADES = {"definition": (2, 8), "numeric": (3, 15), "comparison": (2, 8)}
RATINGS = (("strong", 0.70), ("adequate", 0.45), ("weak", 0.25))

# Claims, dates and update language in text.
MONTHS = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
TEXT_DATE = rf"\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\.?,?\s+(?:19|20)\d{{2}}\b|\b(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/(?:19|20)\d{{2}}\b"
UPDATE_LANGUAGE = r"\b(last updated|updated on|updated:|revised|last reviewed|reviewed on|changelog|revision history|what'?s new|edited on|version \d)\b"
STATISTIC = r"(\b\d{1,3}(?:\.\d+)?\s?%|\b\d{1,3}(?:,\d{3})+\b|\b\d+(?:\.\d+)?\s?(?:million|billion|thousand|k\+|m\+)\b|\b\d+(?:\.\d+)?x\b|\b\d{2,}\s?\+?\s?(?:customers|clients|users|companies|countries|employees|installs|downloads|projects|partners)\b)"
SUPERLATIVE = r"\b(#\s?1\b|number one|the (?:leading|largest|fastest|best|most trusted|most popular|top)\b|world'?s (?:best|leading|largest|first)|industry[- ]leading|award[- ]winning|market leader|best[- ]in[- ]class|the only \w+ that)\b"

# URL lists and patterns.
ALLOWED_PORTS = (80, 443, 8000, 8080, 8443)
METADATA_HOSTS = ("metadata.google.internal", "metadata.goog", "169.254.169.254", "fd00:ec2::254", "100.100.100.200")
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "broadcasthost", "0.0.0.0", "[::]", "::", "::1")
RESERVED_SUFFIXES = (".localhost", ".local", ".internal", ".intranet", ".private", ".corp", ".home", ".lan", ".home.arpa", ".test", ".example", ".invalid")
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac", "mil", "or", "ne", "go", "in", "nom", "sch", "gob", "asn", "id", "plc", "ltd", "me")
PAGE_TYPES = (
    ("product", r"/(product|products|item|shop|store|p)/"), ("pricing", r"/(pricing|plans|price)"), ("article", r"/(blog|news|article|post|insights|resources)/"), ("docs", r"/(docs|documentation|guide|help|support|kb)/"),
    ("about", r"/(about|company|team|contact|who-we-are)"), ("service", r"/(service|services|solutions|platform|features)"), ("legal", r"/(privacy|terms|legal|cookie|gdpr)"), ("category", r"/(category|collection|topics|tag)/"),
)
SKIP_EXTENSIONS = r"\.(pdf|jpg|jpeg|png|gif|webp|svg|ico|css|js|mp4|mp3|zip|gz|woff2?|ttf|eot|xml|json|rss|atom)$"
SKIP_PATHS = r"/(wp-admin|wp-content|wp-includes|cdn-cgi|_next/static|assets|static|login|signin|signup|register|logout|cart|checkout|account|admin|api)(/|$)"

# Host families by suffix, in order of precedence.
HOST_FAMILIES = (
    ("encyclopedia", ("wikipedia.org", "wikidata.org", "britannica.com", "wikimedia.org",)),
    ("academic_publishing", ("doi.org", "arxiv.org", "springer.com", "nature.com", "sciencedirect.com", "jstor.org", "acm.org", "ieee.org", "ssrn.com", "biorxiv.org", "tandfonline.com", "wiley.com",)),
    ("academic", (".edu", ".ac.uk", ".edu.au", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov",)),
    ("government", (".gov", ".gov.uk", ".mil", "europa.eu", "who.int", "un.org", "oecd.org",)),
    ("standards", ("w3.org", "ietf.org", "iso.org", "nist.gov", "unicode.org", "rfc-editor.org",)),
    ("news_media", ("nytimes.com", "bbc.co.uk", "bbc.com", "reuters.com", "forbes.com", "bloomberg.com", "wsj.com", "theguardian.com", "cnbc.com", "wired.com", "techcrunch.com", "theverge.com", "venturebeat.com", "ft.com", "businessinsider.com", "axios.com", "cnn.com",)),
    ("press_wire", ("prnewswire.com", "businesswire.com", "globenewswire.com", "einpresswire.com", "prweb.com", "newswire.com",)),
    ("social", ("twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "threads.net",)),
    ("review_platform", ("g2.com", "capterra.com", "trustpilot.com", "gartner.com", "getapp.com", "producthunt.com", "yelp.com",)),
)

# Signals in raw markup.
STATE_BLOBS = {
    "Next.js": r"__NEXT_DATA__|_next/static|self\.__next_f", "Nuxt": r"__NUXT__|window\.__NUXT|/_nuxt/", "Gatsby": r"___gatsby|window\.page-data|/page-data/", "Redux/Vuex": r"__INITIAL_STATE__|__PRELOADED_STATE__|__APOLLO_STATE__",
    "SvelteKit": r"__sveltekit_|/_app/immutable/", "Remix": r"__remixContext|__remixManifest", "Angular": r"ng-version=|<app-root|ngcontent", "Astro": r"astro-island|astro-slot",
}
FRAMEWORKS = {
    "React": r"react(?:-dom)?[.@\-/]|data-reactroot|__reactContainer", "Vue": r"\bvue(?:\.runtime)?[.@\-/]|data-v-[0-9a-f]{8}|v-cloak",
    "Angular": r"@angular|ng-version", "Svelte": r"\bsvelte[.@\-/]", "Ember": r"ember(?:-cli)?[.@\-/]",
}
EMPTY_MOUNT = r"<(?:div|main|section|app-root)[^>]*\b(?:id|class)\s*=\s*[\"'](root|app|__next|___gatsby|__nuxt|main-content|application)[\"'][^>]*>\s*</(?:div|main|section|app-root)>"
CLOSED_MOUNT = r"<(?:div|app-root)[^>]*\b(?:id|class)\s*=\s*[\"'](root|app|__next|___gatsby)[\"'][^>]*/?>\s*<script"
LAZY = r"\b(?:loading\s*=\s*[\"']lazy[\"']|data-src\s*=|data-lazy|data-defer|IntersectionObserver)"
SKELETON = r"\b(?:skeleton|placeholder|shimmer|is-loading|spinner|loading-state|content-loader)\b"
CLIENT_ROUTER = r"\b(?:react-router|vue-router|@angular/router|history\.pushState|createBrowserRouter|useNavigate)\b"
HASH_ROUTE = r"href\s*=\s*[\"']#!?/"

# Markup that carries no text, blocks, and words of chrome and content regions.
SILENT_TAGS = ("script", "style", "template", "noscript", "svg", "canvas", "iframe")
BLOCKS = (
    "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr",
    "blockquote", "pre", "figcaption", "dd", "dt", "br", "hr", "form", "ul", "ol", "table",
)
CHROME_WORDS = r"\b(nav|menu|header|footer|sidebar|breadcrumb|cookie|consent|banner|newsletter|subscribe|social|share|advert|promo|modal|popup|skip-link)\b"
CONTENT_WORDS = r"\b(main|content|article|post|entry|body|prose|documentation)\b"

# Date properties, sitemap and date formats.
PUBLISHED_META = (
    "article:published_time", "og:published_time", "publish_date", "pubdate", "date", "dc.date", "dcterms.date", "dcterms.created",
    "citation_publication_date", "sailthru.date", "parsely-pub-date", "article:published",
)
MODIFIED_META = ("article:modified_time", "og:updated_time", "last-modified", "dcterms.modified", "revised", "parsely-update-date")
PUBLISHED_LD, MODIFIED_LD = ("datePublished", "dateCreated", "uploadDate", "startDate"), ("dateModified", "lastReviewed")
DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m", "%Y",
    "%a, %d %b %Y %H:%M:%S %Z", "%a, %d %b %Y %H:%M:%S %z",
)

# Ranks, ceilings and thresholds.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CEILINGS = {1: "critical", 2: "high", 3: "medium"}
CHROME_SHARE = 0.8

# Promotional words of a page's beginning, and words of missing pages under a good status.
LEAD_WORDS = 150
MARKETING = (
    r"\b(industry[- ]leading|world[- ]class|best[- ]in[- ]class|cutting[- ]edge|state[- ]of[- ]the[- ]art|revolutionary|game[- ]chang\w+|seamless\w*|synerg\w+|next[- ]generation|innovat(?:ive|ion)|empower\w*|unlock\w*|"
    r"transform(?:ing|ative|ation)?|elevat\w+|unparalleled|unrivalled|unrivaled|bespoke|holistic|turnkey|frictionless|effortless\w*|reimagin\w+|passionate|delight\w*|journey|mission[- ]driven|thought leader\w*)\b"
)
SOFT_404 = r"\b(page not found|404 error|does not exist|no longer available|couldn'?t find|nothing here|sorry,? we can'?t find)\b"
BRAND_SUFFIXES = r"(group|solutions|services|systems|digital|media|labs?|tech|technologies|consulting|partners|holdings|ventures|studio|agency|works|global|online)$"

# Markup that stands before a page, strong and weak signs, and breadcrumbs.
STRONG_LAYERS = {
    "open dialog": r"<dialog\b[^>]*\bopen\b",
    "modal": r"aria-modal\s*=\s*[\"']?true",
    "scroll lock": r"<body\b[^>]*class\s*=\s*[\"'][^\"']*\b(modal-open|no-scroll|noscroll|overflow-hidden|scroll-locked|menu-open-body)\b",
    "wall": r"\b(paywall|regwall|age[-_ ]?gate|age[-_ ]verification|subscribe[-_ ]wall|registration[-_ ]wall|content[-_ ]lock)\b",
}
WEAK_LAYERS = {
    "consent": r"(id|class)\s*=\s*[\"'][^\"']*\b(cookie[-_ ]?(banner|consent|notice|wall)|consent[-_ ]?(banner|modal|manager|dialog)|gdpr[-_ ]?(banner|modal)|cmp[-_ ]?(container|banner))\b",
    "popup": r"(id|class)\s*=\s*[\"'][^\"']*\b(newsletter[-_ ]?(modal|popup|overlay)|exit[-_ ]?intent|signup[-_ ]?(modal|overlay)|promo[-_ ]?(modal|overlay)|lightbox[-_ ]?overlay|interstitial)\b",
    "overlay": r"style\s*=\s*[\"'][^\"']*position\s*:\s*fixed[^\"']*z-index\s*:\s*\d{3,}",
}
BREADCRUMB = r"(class|id)\s*=\s*[\"'][^\"']*\bbreadcrumbs?\b|aria-label\s*=\s*[\"']breadcrumb"
NO_FIELDS, MOST_FORMS = ("hidden", "submit", "button", "image", "reset", "search"), 6

# Types of structured data.
GENERIC_TYPES = (
    "WebPage", "WebSite", "BreadcrumbList", "SearchAction", "SiteNavigationElement", "ImageObject", "Person", "Thing", "Graph", "ListItem", "EntryPoint", "ReadAction", "PostalAddress", "ContactPoint", "Offer", "AggregateRating", "OpeningHoursSpecification", "GeoCoordinates", "Rating", "Review",
)
ORGANIZATION_TYPES = (
    "Organization", "Corporation", "LocalBusiness", "OnlineBusiness", "NGO", "EducationalOrganization", "GovernmentOrganization", "Store", "Restaurant", "MedicalBusiness", "ProfessionalService", "SportsOrganization", "NewsMediaOrganization",
)
PRIMARY_TYPES = {
    "product": ("Product", "ProductGroup", "IndividualProduct", "SoftwareApplication", "Vehicle", "Book"),
    "article": ("Article", "BlogPosting", "NewsArticle", "TechArticle", "ScholarlyArticle", "Report"),
    "howto": ("HowTo", "Recipe"), "event": ("Event", "BusinessEvent", "EducationEvent"), "job": ("JobPosting",), "course": ("Course",), "faq": ("FAQPage", "QAPage"),
}
_ARTICLE = {"headline": ("headline", "name"), "datePublished": ("datePublished", "dateCreated"), "author": ("author", "creator")}
REQUIRED_PROPERTIES = {
    "Product": {"name": ("name",), "offers or price": ("offers", "price", "aggregateOffer")},
    "ProductGroup": {"name": ("name",), "offers or price": ("offers", "price", "hasVariant")},
    "SoftwareApplication": {"name": ("name",), "offers or applicationCategory": ("offers", "applicationCategory")},
    "Article": _ARTICLE, "BlogPosting": _ARTICLE, "NewsArticle": _ARTICLE,
    "TechArticle": {"headline": ("headline", "name"), "datePublished": ("datePublished", "dateCreated")},
    "LocalBusiness": {"name": ("name",), "address": ("address",), "telephone or contactPoint": ("telephone", "contactPoint")},
    "Event": {"name": ("name",), "startDate": ("startDate",), "location": ("location",)},
    "JobPosting": {"title": ("title", "name"), "datePosted": ("datePosted",), "hiringOrganization": ("hiringOrganization",)},
    "Recipe": {"name": ("name",), "recipeIngredient": ("recipeIngredient",), "recipeInstructions": ("recipeInstructions",)},
    "HowTo": {"name": ("name",), "step": ("step",)}, "FAQPage": {"mainEntity": ("mainEntity",)}, "BreadcrumbList": {"itemListElement": ("itemListElement",)},
    "Course": {"name": ("name",), "description": ("description",), "provider": ("provider",)},
}
ORGANIZATION_FIELDS = {
    "name": ("name", "legalName"), "url": ("url",), "logo": ("logo", "image"), "description": ("description",),
    "contact point": ("contactPoint", "telephone", "email", "address"),
}
ADDRESS_KEYS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry", "name")

# What is expected of a page of each type (types of structured data, least words, a date),
# whether it only leads elsewhere, matters most, or is exempt from the score.
PAGE_EXPECTATIONS = {
    "homepage": (("Organization", "WebSite", "LocalBusiness", "Corporation"), 150, False, False, True, False),
    "product": (("Product", "Offer", "AggregateOffer", "ItemList"), 120, False, False, True, False),
    "pricing": (("Product", "Offer", "PriceSpecification", "Service"), 100, False, False, True, False),
    "article": (("Article", "BlogPosting", "NewsArticle", "TechArticle"), 300, True, False, False, False),
    "docs": (("TechArticle", "HowTo", "Article", "APIReference"), 200, True, False, False, False),
    "about": (("Organization", "AboutPage", "Corporation"), 120, False, False, False, False),
    "service": (("Service", "Product", "Offer"), 150, False, False, True, False),
    "category": (("CollectionPage", "ItemList", "BreadcrumbList"), 60, False, True, False, False),
    "legal": ((), 100, True, False, False, True),
    "other": (("WebPage",), 120, False, False, False, False),
}
THRESHOLDS = {"thin_words": 170.0, "min_headings": 1.0, "low_paragraphs": 8.34, "absorption_floor": 0.25, "render_gap_words": 120.0}
LEAST_ABSORBABLE_WORDS, HEDGES, GAP_WORDS = 300, 5, 120
CORROBORATING, AMPLIFYING = ("encyclopedia", "academic_publishing", "academic", "government", "standards"), ("news_media", "press_wire", "social", "review_platform")
