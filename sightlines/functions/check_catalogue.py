"""The catalogue of 116 page checks as data: (family, category, check, severity, passes, partly).

`passes` and `partly` are SQL conditions over the columns of `check_facts`;
"manual" asks for a person, "unknown" marks what a page alone does not tell.
"""

from __future__ import annotations

# Fixed checks, by family and category.
GEO = {
    "Crawlability & indexability": [
        ("Page answers with success", "critical", "http_status BETWEEN 200 AND 299", None), ("Served over HTTPS", "high", "url LIKE 'https://%'", None), ("Indexing is allowed", "critical", "NOT robots LIKE '%noindex%'", None), ("Robots file allows the page", "high", "unknown", None),
        ("Canonical points to itself", "high", "canonical <> '' AND rtrim('/', canonical) = rtrim('/', url)", "canonical <> ''"), ("Sitemap can be found", "medium", "unknown", None), ("Enough text in the HTML", "high", "words >= 200", "words >= 80"), ("Snippets are allowed", "medium", "NOT robots LIKE '%nosnippet%'", None),
    ],
    "Entity clarity": [
        ("Has a title", "high", "title <> ''", None), ("Has exactly one main heading", "medium", "h1_count = 1", "h1_count > 1"), ("Names an organization or person type", "medium", "arrays_overlap(types, array('Organization', 'Corporation', 'LocalBusiness', 'Person'))", None), ("Links to an about page", "medium", "links RLIKE 'about|company|team'", None),
        ("Links to a contact page", "medium", "links RLIKE 'contact|support'", None), ("Links to profiles of the entity", "medium", "array_contains(fields, 'sameAs') OR links RLIKE 'linkedin|facebook|twitter|youtube|instagram'", None), ("Has a description", "medium", "description <> ''", None), ("Names are used consistently", "low", "manual", None),
    ],
    "Structured data": [
        ("Has structured data", "high", "size(jsonld) > 0", None), ("All structured data parses", "high", "size(jsonld) > 0 AND jsonld_bad = 0", None), ("Declares a page or site type", "medium", "arrays_overlap(types, array('WebPage', 'WebSite', 'AboutPage', 'ProfilePage', 'CollectionPage'))", None), ("Declares who is responsible", "medium", "array_contains(types, 'Organization') OR arrays_overlap(fields, array('author', 'publisher'))", None),
        ("Type fits the page", "medium", "array_contains(types, expected_type)", "size(jsonld) > 0"), ("Inner page has breadcrumbs", "low", "depth = 0 OR array_contains(types, 'BreadcrumbList')", None), ("Declares a main entity", "low", "arrays_overlap(fields, array('mainEntity', 'about'))", None), ("Structured name is visible", "medium", "name_shown", None),
    ],
    "Evidence & citations": [
        ("Links to outside sources", "medium", "external_links >= 2", "external_links = 1"), ("Numbers are attributed", "medium", "numbers = 0 OR attributed", None), ("Uses words of attribution", "low", "attributed", None), ("Shows dates", "low", "dated", None),
        ("Article names its author", "medium", "page_kind <> 'blog_post' OR authored", None), ("Has a list of references", "low", "t RLIKE 'references|sources|bibliography'", None), ("Sources support the claims", "high", "manual", None), ("Claims are up to date", "medium", "manual", None),
    ],
    "Authority & trust": [
        ("About page is reachable", "medium", "links RLIKE 'about'", None), ("Contact page is reachable", "medium", "links RLIKE 'contact'", None), ("Privacy page is reachable", "medium", "links RLIKE 'privacy|terms|legal'", None), ("Names people", "medium", "authored", None),
        ("Shows certifications", "low", "t RLIKE 'certified|certification|accredited|licensed|award'", None), ("Shows attributable reviews", "low", "t RLIKE 'testimonial|reviews' OR arrays_overlap(types, array('Review', 'AggregateRating'))", None), ("Has an editorial policy", "low", "links RLIKE 'editorial|corrections'", None), ("Reputation elsewhere", "medium", "manual", None),
    ],
    "Content depth": [
        ("Is long enough for its kind", "high", "words >= CASE WHEN page_kind = 'blog_post' THEN 500 ELSE 250 END", "words >= 120"), ("Title and heading are there", "medium", "title <> '' AND h1_count > 0", "title <> ''"), ("Has sections", "medium", "h2_count >= 2", "h2_count = 1"), ("Gives examples", "low", "t RLIKE 'for example|case study|such as'", None),
        ("Compares, with a table", "low", "compares AND tables > 0", "compares OR tables > 0"), ("Answers frequent questions", "low", "faq", None), ("Has media", "low", "images > 0", None), ("Says something of its own", "high", "manual", None),
    ],
    "Technical delivery": [
        ("Few redirects", "medium", "hops <= 1", "hops <= 3"), ("Declares a character set", "low", "html_low LIKE '%charset%'", None), ("Has a viewport", "medium", "viewport", None), ("Response is compressed", "low", "unknown", None),
        ("Has a cache policy", "low", "unknown", None), ("Enforces HTTPS", "low", "unknown", None), ("Images have alternatives", "medium", "images_no_alt = 0", "images_no_alt <= 0.2 * images"), ("Links to other pages of the site", "medium", "internal_links >= 5", "internal_links >= 1"),
    ],
}
AEO = {
    "Question & intent": [
        ("Headings ask questions", "medium", "questions >= 2", "questions = 1"), ("Opens with a direct answer", "high", "opening BETWEEN 20 AND 120", "opening > 0"), ("Covers several question forms", "low", "question_forms >= 3", "question_forms >= 1"), ("Has a question section", "low", "faq", None), ("Marks questions up", "low", "array_contains(types, 'FAQPage')", None),
        ("Compares alternatives", "low", "compares", None), ("Explains a procedure", "low", "procedure", None), ("States transactional facts", "low", "page_kind NOT IN ('product', 'service') OR t RLIKE 'price|cost|delivery|opening hours|[0-9]+ ?(eur|usd)'", None), ("Matches the intent of its queries", "high", "manual", None), ("Serves a clear audience", "medium", "manual", None),
    ],
    "Extractability": [
        ("Paragraphs are short", "medium", "mean_paragraph <= 100", "mean_paragraph <= 160"), ("Has lists", "low", "lists > 0", None), ("Has tables", "low", "tables > 0", None), ("Gives definitions", "low", "t RLIKE ' (is a|means|refers to) '", None), ("States figures", "low", "numbers >= 2", "numbers = 1"),
        ("Attributes statements", "low", "attributed", None), ("Is cut in sections", "medium", "h2_count >= 2", "h2_count = 1"), ("Headings can be linked to", "low", "heading_ids * 2 >= size(headings) AND size(headings) > 0", "heading_ids > 0"), ("Has text to extract", "high", "words >= 100", "words >= 50"), ("Passages stand alone", "medium", "manual", None),
    ],
    "Semantic structure": [
        ("One main heading", "medium", "h1_count = 1", "h1_count > 1"), ("Heading levels do not jump", "medium", "NOT jumps", None), ("Second-level headings", "medium", "h2_count >= 2", "h2_count = 1"), ("Uses landmarks", "low", "html_low RLIKE '<(main|article|nav|header|footer)[ >]'", None), ("Links describe their target", "low", "NOT vague_links", None),
        ("Declares a canonical address", "medium", "canonical <> ''", None), ("Declares its language", "medium", "lang <> ''", None), ("Has breadcrumbs", "low", "array_contains(types, 'BreadcrumbList') OR html_low LIKE '%breadcrumb%'", None), ("Links inside the site", "medium", "internal_links >= 5", "internal_links >= 1"), ("Alternatives for images", "medium", "images_no_alt = 0", "images_no_alt <= 0.2 * images"),
    ],
    "Clarity": [
        ("Title has a good length", "medium", "length(title) BETWEEN 15 AND 65", "title <> ''"), ("Description has a good length", "medium", "length(description) BETWEEN 70 AND 170", "description <> ''"), ("Sentences are short", "medium", "mean_sentence <= 25", "mean_sentence <= 35"), ("Paragraphs are clear", "medium", "mean_paragraph <= 100", "mean_paragraph <= 160"), ("Few unexplained acronyms", "low", "acronyms <= 0.03 * words", "acronyms <= 0.06 * words"),
        ("Headings are short", "low", "long_headings = 0", "long_headings <= 2"), ("Headings differ", "low", "size(array_distinct(headings)) = size(headings)", None), ("Shows how fresh it is", "medium", "dated", None), ("Says who wrote it", "low", "authored", None), ("Reads well", "medium", "manual", None),
    ],
    "Experience": [
        ("Images are described", "medium", "images_no_alt = 0", None), ("Controls have labels", "medium", "inputs = 0 OR labels >= inputs", "labels > 0"), ("Buttons have names", "medium", "NOT empty_buttons", None), ("Fits small screens", "high", "viewport", None), ("Language is known", "medium", "lang <> ''", None),
        ("Offers a way past the menu", "low", "html_low RLIKE 'skip to|skip-link|#main'", None), ("Headings come in order", "medium", "NOT jumps", None), ("Link purposes are clear", "low", "NOT vague_links", None), ("Works by keyboard", "medium", "manual", None), ("Has enough contrast", "medium", "manual", None),
    ],
    "Eligibility": [
        ("Can be indexed", "critical", "http_status BETWEEN 200 AND 299 AND NOT robots LIKE '%noindex%' AND words > 0", None), ("Can be quoted", "high", "NOT robots RLIKE 'nosnippet|max-snippet:0'", None), ("Has markup", "medium", "size(jsonld) > 0", None), ("Markup is valid", "medium", "size(jsonld) > 0 AND jsonld_bad = 0", None), ("Markup fits the page", "medium", "array_contains(types, expected_type)", None),
        ("Markup has its main fields", "medium", "arrays_overlap(fields, array('name', 'headline'))", None), ("Sharing data is complete", "low", "size(og_missing) = 0", "size(og_missing) < 3"), ("Has a sharing card", "low", "NOT array_contains(twitter_missing, 'card')", None), ("Has an icon", "low", "html_low LIKE '%rel=\"icon%' OR html_low LIKE '%shortcut icon%'", None), ("Is shown by answer engines", "medium", "manual", None),
    ],
}
WEIGHTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
EXPECTED = {"homepage": "WebSite", "blog_post": "Article", "blog_index": "CollectionPage", "product": "Product", "service": "Service", "contact": "ContactPage", "unknown": "WebPage"}


def catalogue() -> list[tuple[str, str, str, str, str, str | None]]:
    return [(f, c, *row) for f, cats in (("geo", GEO), ("aeo", AEO)) for c, rows in cats.items() for row in rows]
