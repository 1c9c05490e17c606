"""Word lists, weights and patterns.

All are defaults: every operator takes its lists as parameters.  The values below are
fixed values that results depend on, in their natural order.
"""

from __future__ import annotations

# ---- fixed values: query understanding ------------------------------------------------
QUERY_STOPWORDS = ["the", "and", "of", "a", "an", "in", "to", "for", "on", "with", "by", "is", "are", "be", "this", "that", "it"]

FRENCH_MARKERS = [
    "état de l'art", "apprentissage", "diagnostic", "médical", "réseau", "données", "recherche", "algorithme", "modèle", "analyse", "étude", "méthode",
    "résultats", "performance", "évaluation", "classification", "prédiction", "optimisation", "traitement", "système", "intelligence artificielle",
    "apprentissage automatique", "avec", "dans", "pour", "sur", "par", "une", "des", "les", "est", "sont", "peut", "plus", "très", "aussi", "bien", "comme",
    "même", "sans", "sous", "entre", "contre", "depuis", "pendant", "selon", "vers", "chez", "du", "de la", "de l'", "au", "aux", "à la", "à l'",
    "qu'est-ce que", "comment", "pourquoi", "quand", "où", "qui", "que", "quoi",
]
ENGLISH_MARKERS = [
    "machine learning", "deep learning", "neural network", "artificial intelligence", "state of the art", "performance", "evaluation", "classification",
    "prediction", "optimization", "algorithm", "model", "analysis", "study", "method", "results", "research", "medical", "diagnostic", "network", "data",
    "system", "the", "and", "for", "with", "from", "this", "that", "these", "those", "what", "when", "where", "why", "how", "which", "who", "whom", "can",
    "could", "should", "would", "will", "shall", "may", "might", "have", "has", "had", "been", "being", "are", "is", "was", "were", "about", "above",
    "across", "after", "against", "along", "among", "around", "before", "behind", "below", "beneath", "beside", "between", "beyond", "during", "except",
    "inside", "into", "like", "near", "outside", "over", "since", "through", "throughout", "under", "until", "upon", "within", "without",
]

#: intent -> {phrase: weight}, ties go to the intent named first
INTENTS = {
    "survey": {"survey": 2, "state of the art": 2, "état de l'art": 2, "overview": 2, "review": 1, "literature review": 3, "systematic review": 3, "meta-analysis": 2, "comprehensive review": 2},
    "methodology": {"method": 1, "methodology": 2, "approach": 1, "algorithm": 2, "architecture": 2, "technique": 1, "framework": 1, "model": 1, "implementation": 1, "pipeline": 1},
    "application": {"application": 2, "use case": 2, "case study": 2, "diagnosis": 1, "classification": 1, "segmentation": 1, "detection": 1, "deployment": 1, "real-world": 1, "practical": 1},
    "comparison": {"compare": 2, "comparison": 2, "vs": 2, "versus": 2, "benchmark": 2, "evaluation": 1, "performance": 1, "comparative": 2},
    "recent": {"recent": 2, "2023": 1, "2024": 2, "2025": 3, "latest": 2, "new": 1, "current": 1, "modern": 1, "contemporary": 1},
}

# ---- fixed values: summarizers ----------------------------------------------------------
SENTENCE_ABBREVIATIONS = [
    "dr", "prof", "mr", "mrs", "ms", "vs", "etc", "fig", "eq", "ref", "sec", "ch", "vol", "no", "pp", "p", "al", "cf", "i.e", "e.g", "viz", "ca", "approx",
    "est", "max", "min", "avg", "std", "var", "dept", "univ", "corp", "inc", "ltd", "co", "govt", "admin",
]
IMPORTANCE_KEYWORDS = [
    "conclusion", "result", "finding", "significant", "important", "novel", "contribution", "propose", "demonstrate", "show", "prove", "evidence", "analysis",
    "evaluation", "performance", "accuracy", "improvement", "method", "approach", "algorithm",
]
#: 'AI' is never found in a lower-cased text; kept so that the list is the documented one
RESEARCH_INDICATORS = [
    "method", "approach", "algorithm", "technique", "framework", "model", "analysis", "study", "evaluation", "experiment", "results", "findings", "propose",
    "present", "introduce", "develop", "design", "implement", "machine learning", "deep learning", "neural network", "AI", "data science", "classification",
    "prediction", "optimization", "performance", "accuracy",
]
KEY_SENTENCE_PATTERNS = [
    r"\b(we|this paper|our|the method|the approach)\b", r"\b(results?|findings?|shows?|demonstrates?)\b", r"\b(novel|new|improved|efficient|effective)\b", r"\b(compared to|outperforms|achieves)\b",
]

# ---- fixed values: structured analysis --------------------------------------------------
#: section type -> header patterns, tried in this order
SECTION_HEADERS = {
    "abstract": [r"(?i)^\s*(?:abstract|summary|résumé)\s*$", r"(?i)^\s*(?:\d+\.?\s*)?abstract\s*$"],
    "introduction": [
        r"(?i)^\s*(?:\d+\.?\s*)?(?:introduction|background|motivation|overview)\s*$", r"(?i)^\s*(?:i\.?\s*)?introduction\s*$",
        r"(?i)^\s*(?:chapter\s+\d+\s*:?\s*)?introduction\s*$", r"(?i)^\s*(?:section\s+\d+\s*:?\s*)?(?:introduction|background)\s*$",
    ],
    "related_work": [r"(?i)^\s*(?:\d+\.?\s*)?(?:related\s+work|literature\s+review|prior\s+work|previous\s+work)\s*$", r"(?i)^\s*(?:ii\.?\s*)?related\s+work\s*$"],
    "methodology": [
        r"(?i)^\s*(?:\d+\.?\s*)?(?:method(?:ology)?|approach|technique|algorithm|implementation|model|framework)\s*$",
        r"(?i)^\s*(?:\d+\.?\s*)?(?:materials?\s+and\s+methods?|experimental\s+setup|system\s+design)\s*$",
        r"(?i)^\s*(?:iii\.?\s*)?(?:method(?:ology)?|approach)\s*$", r"(?i)^\s*(?:\d+\.?\s*)?(?:proposed\s+method|our\s+approach|solution)\s*$",
    ],
    "results": [
        r"(?i)^\s*(?:\d+\.?\s*)?(?:results?|findings?|experiments?|evaluation|performance|analysis)\s*$",
        r"(?i)^\s*(?:\d+\.?\s*)?(?:experimental\s+results?|empirical\s+evaluation|performance\s+analysis)\s*$", r"(?i)^\s*(?:iv\.?\s*)?(?:results?|evaluation)\s*$",
    ],
    "discussion": [r"(?i)^\s*(?:\d+\.?\s*)?(?:discussion|interpretation|implications|analysis)\s*$", r"(?i)^\s*(?:v\.?\s*)?discussion\s*$"],
    "conclusion": [
        r"(?i)^\s*(?:\d+\.?\s*)?(?:conclusion|summary|final\s+remarks?|closing)\s*$", r"(?i)^\s*(?:\d+\.?\s*)?(?:future\s+work|limitations?\s+and\s+future\s+work)\s*$",
        r"(?i)^\s*(?:vi\.?\s*)?(?:conclusion|summary)\s*$",
    ],
}
#: where sections are expected in a text without headers: type, from, to
POSITIONS = [("introduction", 0.0, 0.15), ("methodology", 0.15, 0.35), ("results", 0.35, 0.65), ("discussion", 0.65, 0.85), ("conclusion", 0.85, 1.0)]

#: facet -> sentence patterns, the first match counts
FACET_PATTERNS = {
    "contributions": [
        r"(?i)(?:our|the|main|key|primary|novel)\s+(?:contribution|novelty|innovation|advance)s?\s+(?:is|are|include)",
        r"(?i)(?:we|this\s+(?:paper|work|study))\s+(?:propose|present|introduce|contribute|develop|make)",
        r"(?i)(?:novel|new|innovative|original|unique)\s+(?:approach|method|technique|algorithm|framework|model|solution)",
        r"(?i)(?:first|pioneering)\s+(?:to|work|study|approach|attempt)", r"(?i)(?:significantly|substantially|dramatically)\s+(?:improve|enhance|outperform|exceed|surpass)",
        r"(?i)(?:state-of-the-art|sota)\s+(?:performance|results|accuracy|precision)", r"(?i)(?:first|second|third|1\.|2\.|3\.)\s*,?\s*(?:we|our|this)",
        r"(?i)(?:achieve|obtain|reach|attain)\s+(?:better|superior|improved|higher)",
    ],
    "methodology": [
        r"(?i)(?:we|our)\s+(?:use|employ|apply|implement|develop|design|adopt|utilize)",
        r"(?i)(?:algorithm|model|framework|approach|method|technique|system)\s+(?:is|was|consists|works|operates)",
        r"(?i)(?:based\s+on|using|utilizing|leveraging|employing|building\s+on)", r"(?i)(?:neural\s+network|machine\s+learning|deep\s+learning|transformer|attention|convolution)",
        r"(?i)(?:training|optimization|learning\s+rate|batch\s+size|epochs?|iterations?)", r"(?i)(?:architecture|network|model)\s+(?:consists|comprises|includes|contains)",
        r"(?i)(?:input|output|hidden)\s+(?:layer|dimension|size|feature)",
    ],
    "results": [
        r"(?i)(?:accuracy|precision|recall|f1|score|performance)\s+(?:of|is|was|reaches?|achieves?)",
        r"(?i)(?:outperform|exceed|surpass|beat)\s+(?:baseline|previous|existing|state-of-the-art)", r"(?i)(?:improvement|gain|increase|boost)\s+(?:of|by|in)\s+[\d.]+%?",
        r"(?i)(?:results?|experiments?)\s+(?:show|demonstrate|indicate|reveal|suggest)", r"(?i)(?:compared\s+to|versus|vs\.?)\s+(?:baseline|previous|existing)",
        r"(?i)(?:statistically\s+)?significant\s+(?:improvement|difference|gain)",
    ],
    "limitations": [
        r"(?i)(?:limitation|drawback|weakness|shortcoming|constraint)s?\s+(?:of|include|are)", r"(?i)(?:however|although|despite|unfortunately|nevertheless)",
        r"(?i)(?:does\s+not|cannot|unable\s+to|fails\s+to|limited\s+to)", r"(?i)(?:future\s+work|further\s+research|next\s+steps?)\s+(?:should|will|could|might)",
        r"(?i)(?:challenging|difficult|hard)\s+(?:to|for)",
    ],
    "future_work": [
        r"(?i)(?:future\s+work|future\s+research|next\s+steps?|further\s+investigation)", r"(?i)(?:plan\s+to|intend\s+to|will|would\s+like\s+to|aim\s+to)",
        r"(?i)(?:extension|improvement|enhancement)\s+(?:of|to|could)", r"(?i)(?:explore|investigate|study|examine|consider)\s+(?:further|more|additional)",
        r"(?i)(?:potential|possible|promising)\s+(?:direction|avenue|approach)",
    ],
}
#: facet -> [(section, weight)], most sentences, bonus keywords, text if nothing was found
FACETS = {
    "contributions": ([("abstract", 1.0), ("introduction", 0.8), ("conclusion", 0.9), ("related_work", 0.3)], 3, ["novel", "new", "first", "innovative", "significant", "improve"], "Contribution not clearly identified in available sections."),
    "methodology": ([("methodology", 1.0), ("introduction", 0.6), ("results", 0.4), ("other", 0.7)], 4, ["algorithm", "model", "framework", "approach", "technique", "implement"], "Methodology not clearly identified in available sections."),
    "results": ([("results", 1.0), ("conclusion", 0.7), ("abstract", 0.6), ("discussion", 0.8)], 4, ["accuracy", "performance", "outperform", "improvement", "significant"], "Results not clearly identified in available sections."),
    "limitations": ([("discussion", 1.0), ("conclusion", 0.8), ("results", 0.6), ("methodology", 0.5)], 3, ["limitation", "however", "challenge", "difficult", "cannot"], "Limitations not explicitly discussed in available sections."),
    "future_work": ([("conclusion", 1.0), ("discussion", 0.8), ("results", 0.5)], 3, ["future", "next", "plan", "explore", "investigate", "extend"], "Future work directions not explicitly mentioned."),
}

PAPER_TYPES = {
    "theoretical": [r"(?i)\b(?:theorem|proof|lemma|proposition|corollary)\b", r"(?i)\b(?:mathematical|formal|theoretical)\s+(?:analysis|framework|model)\b", r"(?i)\b(?:complexity|convergence|optimality)\s+(?:analysis|proof)\b"],
    "empirical": [r"(?i)\b(?:experiment|evaluation|benchmark|dataset|corpus)\b", r"(?i)\b(?:accuracy|precision|recall|f1|performance)\s+(?:score|metric|evaluation)\b", r"(?i)\b(?:training|testing|validation)\s+(?:set|data|phase)\b"],
    "survey": [r"(?i)\b(?:survey|review|overview|taxonomy|classification)\b", r"(?i)\b(?:comprehensive|systematic)\s+(?:review|analysis|study)\b", r"(?i)\b(?:state-of-the-art|existing|current)\s+(?:approaches|methods|techniques)\b"],
    "position": [r"(?i)\b(?:position|opinion|perspective|viewpoint)\s+(?:paper|article)\b", r"(?i)\b(?:argue|claim|advocate|propose)\s+(?:that|for)\b", r"(?i)\b(?:vision|manifesto|call\s+for)\b"],
}
DOMAINS = {
    "machine_learning": [r"(?i)\b(?:machine\s+learning|deep\s+learning|neural\s+network)\b", r"(?i)\b(?:supervised|unsupervised|reinforcement)\s+learning\b", r"(?i)\b(?:gradient|backpropagation|optimization|training)\b"],
    "natural_language_processing": [r"(?i)\b(?:natural\s+language|nlp|text\s+processing)\b", r"(?i)\b(?:tokenization|parsing|sentiment|translation)\b", r"(?i)\b(?:transformer|bert|gpt|attention)\s+(?:model|mechanism)\b"],
    "computer_vision": [r"(?i)\b(?:computer\s+vision|image\s+processing|visual)\b", r"(?i)\b(?:convolutional|cnn|object\s+detection|segmentation)\b", r"(?i)\b(?:pixel|feature\s+extraction|classification)\b"],
    "systems": [r"(?i)\b(?:distributed|parallel|concurrent|scalable)\b", r"(?i)\b(?:database|storage|network|protocol)\b", r"(?i)\b(?:performance|throughput|latency|optimization)\b"],
    "security": [r"(?i)\b(?:security|privacy|cryptography|encryption)\b", r"(?i)\b(?:attack|vulnerability|defense|protection)\b", r"(?i)\b(?:authentication|authorization|access\s+control)\b"],
    "theory": [r"(?i)\b(?:algorithm|complexity|computational)\b", r"(?i)\b(?:graph\s+theory|combinatorics|discrete)\b", r"(?i)\b(?:polynomial|exponential|logarithmic)\s+(?:time|space)\b"],
}
#: facet -> patterns and keywords of the quality score
QUALITY_PATTERNS = {
    "contributions": [r"(?i)\b(?:novel|new|innovative|first|significant|improve)\b", r"(?i)\b(?:propose|present|introduce|develop|achieve)\b", r"(?i)\b(?:contribution|advance|breakthrough|innovation)\b"],
    "methodology": [r"(?i)\b(?:algorithm|model|framework|approach|method)\b", r"(?i)\b(?:implement|design|develop|use|employ)\b", r"(?i)\b(?:training|optimization|evaluation|experiment)\b"],
    "results": [r"(?i)\b(?:accuracy|performance|improvement|outperform)\b", r"(?i)\b(?:significant|better|superior|higher|lower)\b", r"(?i)\b(?:experiment|evaluation|benchmark|comparison)\b"],
    "limitations": [r"(?i)\b(?:limitation|constraint|challenge|difficulty)\b", r"(?i)\b(?:however|although|despite|unfortunately)\b", r"(?i)\b(?:cannot|unable|limited|restricted)\b"],
    "future_work": [r"(?i)\b(?:future|next|further|additional|extend)\b", r"(?i)\b(?:plan|intend|explore|investigate|improve)\b", r"(?i)\b(?:direction|opportunity|potential|possibility)\b"],
}
QUALITY_KEYWORDS = {
    "contributions": ["contribution", "novel", "propose", "present", "new"],
    "methodology": ["method", "approach", "algorithm", "model", "framework"],
    "results": ["results", "performance", "accuracy", "experiment", "evaluation"],
    "limitations": ["limitation", "challenge", "constraint", "however", "difficult"],
    "future_work": ["future", "next", "further", "plan", "explore"],
}

# Patterns of the body text, messages and sentences that results are made of.

REFERENCES_LINE = r"(?i)\n\s*references\s*\n"
CITATION_NUMBERS = r"\[(?:\s*\d+\s*(?:,\s*\d+)*\s*)\]"
CITATION_NAMES = r"\((?:[A-Z][a-zA-Z\-']+\s+et\s+al\.|[A-Z][a-zA-Z\-']+),?\s*\d{4}[a-z]?\)"
TABLE_LINE, FIGURE_LINE = r"(?i)^table\s+\d+", r"(?i)^figure\s+\d+"

RECOMMEND_POOR = "Consider using a different PDF or improving text extraction quality"
RECOMMEND_FAIR = "Summary quality is fair - consider manual review and editing"
RECOMMEND_MUCH, RECOMMEND_SOME = "The {} section needs significant improvement - consider manual extraction", "The {} section could benefit from additional context or refinement"
RECOMMEND_MISSING = "Critical sections missing or inadequate: "

#: facet -> sections whose latent-semantic summary stands in for its findings
FACET_FALLBACK = {"contributions": ["abstract", "introduction"], "methodology": ["methodology", "other"], "results": ["results", "discussion"]}

FINAL_RESPONSES = {
    "offline": ") focuses on the research described in the abstract. The key findings include insights from multiple analysis methods.",
    "empty": ". Based on multiple analysis methods, the work appears to focus on the key concepts and findings described in the abstract and summaries.",
    "timeout": ". Based on the analysis summaries, this work contributes valuable insights to the field.",
    "connection": " presents important research findings. The analysis suggests significant contributions to the field.",
    "error": " contains valuable research insights based on the available analysis.",
}
NO_REWRITE = "Ollama not available for abstractive summarization."
NO_ABSTRACT = "No abstract available"
