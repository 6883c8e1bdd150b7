"""Enumerations and keyword lists of the document-graph model, in natural order."""

# Section types, atom categories, citation roles, intents, chunk kinds.
SECTIONS = ("abstract", "introduction", "related_work", "method", "experiments", "results", "discussion", "conclusion", "appendix", "other")
CATEGORIES = ("data", "preprocessing", "method", "objective", "procedure", "parameter", "evaluation", "baseline", "theory")
ROLES = (
    "method_dependency", "objective_dependency", "data_dependency", "preprocessing_dependency", "evaluation_dependency", "baseline_dependency",
    "procedure_dependency", "theory_dependency", "contradicts", "ablation_reference", "engineering_reference", "related_work_only",
)
CRITICAL_ROLES = ROLES[:8]
INTENTS = ("mention", "background", "result", "method", "extends", "contrasts")
CHUNK_KINDS = ("prose", "table", "caption", "reference", "equation_block", "answer")
STATUSES = ("pass", "partial", "fail", "not_attempted")

# Weights.
ROLE_WEIGHT = {r: 1.0 for r in ROLES} | {"theory_dependency": 0.8, "ablation_reference": 0.5, "engineering_reference": 0.5, "related_work_only": 0.2}
INTENT_WEIGHT = {"mention": 0.2, "background": 0.4, "result": 0.8, "method": 1.2, "extends": 1.5, "contrasts": 1.0}
KIND_QUALITY = {"table": 0.55, "caption": 0.45, "reference": 0.30, "equation_block": 0.50, "answer": 0.80}
SECTION_PRIORITY = {"method": 1.0, "experiments": 0.8, "results": 0.6, "appendix": 0.5, "discussion": 0.4, "introduction": 0.3, "other": 0.3, "abstract": 0.2, "conclusion": 0.2, "related_work": 0.15}
GRADE_WEIGHT = {"pass": 1.0, "partial": 0.5, "fail": 0.0, "not_attempted": 0.0}
DEDUP_COSINE = {"data": 0.95, "evaluation": 0.92, "baseline": 0.92, "method": 0.85, "objective": 0.88, "procedure": 0.90, "parameter": 0.90, "preprocessing": 0.88, "theory": 0.92}
DEDUP_COSINE_DEFAULT = 0.88
ROLE_CATEGORY = {r: r.removesuffix("_dependency") for r in CRITICAL_ROLES}
CATEGORY_COMPONENT = {c: "procedure" if c == "parameter" else c for c in CATEGORIES}

# Section titles, first match wins.
SECTION_TITLES = (
    ("abstract", ("abstract",)), ("introduction", ("introduction", "intro")), ("related_work", ("related work", "background", "prior work", "literature")),
    ("method", ("method", "approach", "model", "architecture", "framework", "system")), ("experiments", ("experiment", "setup", "training details", "implementation details")),
    ("results", ("result", "evaluation", "benchmark", "analysis")), ("discussion", ("discussion",)), ("conclusion", ("conclusion", "summary")), ("appendix", ("appendix", "supplementary")),
)
METHOD_TITLES = ("method", "approach", "architecture", "model", "framework", "algorithm", "training", "loss", "objective", "optimization", "implementation", "preprocess", "dataset", "experiment", "evaluation", "metric", "ablation", "result")

# Keywords of each role, with what one counts.
ROLE_KEYWORDS = {
    "method_dependency": (0.15, (
        "architecture", "encoder", "decoder", "transformer", "attention", "backbone", "block", "module", "layer", "network", "head", "scheme", "integrator", "solver",
        "discretization", "lattice", "mesh", "grid", "ensemble", "synthesis", "reaction", "protocol", "pipeline", "assay", "pathway", "algorithm", "procedure", "routine", "method")),
    "objective_dependency": (0.2, (
        "loss", "objective", "log-likelihood", "regulariz", "kl", "cross-entropy", "contrastive", "reward", "penalty", "hamiltonian", "lagrangian", "action", "energy function",
        "free energy", "potential", "partition function", "yield", "selectivity", "binding affinity", "fitness", "cost", "loss function", "minimization", "maximization")),
    "data_dependency": (0.18, (
        "dataset", "corpus", "benchmark", "split", "training set", "test set", "validation", "measurement", "observation", "sample", "specimen", "snapshot", "trajectory", "trace",
        "spectrum", "image stack", "sequence", "compound", "molecule", "patient", "cohort", "data")),
    "preprocessing_dependency": (0.18, (
        "preprocess", "tokeniz", "augment", "normaliz", "patchif", "embed", "filter", "denoise", "downsamp", "upsamp", "rescale", "standardiz", "calibrat", "background subtract",
        "imputation", "alignment")),
    "evaluation_dependency": (0.18, (
        "evaluat", "metric", "benchmark", "score", "accuracy", "convergence", "diagnostic", "validation", "fidelity", "verification", "cross-validation", "spectra", "chromatograph",
        "performance", "criterion", "test against", "compare to")),
    "baseline_dependency": (0.2, ("baseline", "we compare", "outperform", "against", "previous best", "prior method", "control", "standard", "reference method")),
    "procedure_dependency": (0.2, (
        "adam", "sgd", "warmup", "schedule", "learning rate", "lr", "mixed precision", "ema", "weight decay", "training step", "training loop", "fine-tune", "distill", "integrator",
        "time step", "monte carlo", "molecular dynamics", "annealing", "thermostat", "barostat", "trotter", "reaction conditions", "incubation", "centrifuge", "pcr cycle", "wash step",
        "elution", "iteration", "step size", "tolerance")),
    "theory_dependency": (0.2, (
        "theorem", "lemma", "proof", "assumption", "convergence", "bound", "inequality", "corollary", "conjecture", "axiom", "hypothesis", "principle", "law", "invariant")),
    "ablation_reference": (0.3, ("ablation", "we ablate", "removing", "without the", "with vs without", "leave-one-out")),
    "engineering_reference": (0.18, (
        "pytorch", "tensorflow", "jax", "cuda", "flashattention", "deepspeed", "library", "framework", "implement", "codebase", "repository", "lammps", "gromacs", "vasp", "openmm",
        "gromos", "amber", "gaussian", "psi4", "scipy", "numpy", "compile", "build system", "ci/cd", "wrapper")),
    "contradicts": (0.25, (
        "unlike", "in contrast", "however", "we disagree", "refute", "contradict", "fails to", "fail to", "does not", "cannot", "outperform", "worse than", "differs from",
        "instead of", "contrary to", "counter to")),
}
TITLE_KEYWORDS = {
    "data_dependency": ("dataset", "corpus", "benchmark", "samples", "measurements"),
    "procedure_dependency": ("optimizer", "training", "annealing", "monte carlo", "molecular dynamics", "integrator", "scheduler", "solver"),
    "method_dependency": ("transformer", "attention", "encoder", "network", "algorithm", "scheme", "method", "framework", "system"),
    "theory_dependency": ("theorem", "convergence", "bound", "principle", "law", "axiom"),
    "evaluation_dependency": ("evaluation", "metric", "benchmark", "convergence diagnostic"),
    "baseline_dependency": ("baseline", "reference"),
}
INTENT_KEYWORDS = {
    "method": (0.18, (
        "we use", "we adopt", "we follow", "we apply", "we employ", "based on", "follows", "following", "implement", "leverag", "build on", "built on", "borrow", "borrowed", "adopt",
        "as in", "akin to", "similar to")),
    "extends": (0.25, ("we extend", "extend the", "we generalize", "we build on", "improves upon", "improve upon", "we improve", "enhance", "we modify", "our extension")),
    "result": (0.18, (
        "achieve", "achieves", "achieved", "report", "reports", "reported", "outperform", "outperforms", "outperformed", "accuracy", "score", "result", "f1", "rouge", "bleu")),
    "background": (0.18, ("prior work", "previous work", "earlier work", "introduced", "originally proposed", "first proposed", "popularized", "seminal", "classical")),
    "contrasts": (0.3, (
        "unlike", "contrary", "however", "in contrast", "fails to", "does not", "cannot", "no longer", "refute", "we disagree", "differs from", "outperform", "worse than", "instead of")),
}

# What a section adds to roles and intents (the empty section: an edge without a paragraph).
ROLE_SECTIONS = {
    "method": {"method_dependency": 0.4, "objective_dependency": 0.4, "preprocessing_dependency": 0.4},
    "experiments": {"data_dependency": 0.4, "evaluation_dependency": 0.4, "baseline_dependency": 0.4},
    "related_work": {"related_work_only": 0.6}, "introduction": {"related_work_only": 0.3},
}
INTENT_SECTIONS = {
    "method": {"method": 0.5, "extends": 0.15}, "experiments": {"result": 0.45, "method": 0.1}, "results": {"result": 0.45}, "related_work": {"background": 0.5, "mention": 0.15},
    "introduction": {"background": 0.25, "mention": 0.2}, "abstract": {"mention": 0.3}, "conclusion": {"mention": 0.3}, "": {"mention": 0.4},
}
# What equations, algorithms and tables near a citation add.
ROLE_ARTIFACTS = {
    "equations": {"objective_dependency": 0.25, "method_dependency": 0.15, "theory_dependency": 0.15}, "algorithms": {"method_dependency": 0.2, "procedure_dependency": 0.2},
    "tables": {"baseline_dependency": 0.2, "evaluation_dependency": 0.2},
}

# Nouns that name an atom's category, and names that aren't atoms.
SUFFIX_CATEGORY = {
    "method": "method", "model": "method", "scheme": "method", "algorithm": "method", "architecture": "method", "encoder": "method", "decoder": "method", "objective": "objective",
    "loss": "objective", "function": "objective", "criterion": "objective", "reward": "objective", "dataset": "data", "benchmark": "data", "corpus": "data", "sample": "data",
    "measurement": "data", "optimizer": "procedure", "solver": "procedure", "integrator": "procedure", "scheduler": "procedure", "procedure": "procedure", "protocol": "procedure",
    "reaction": "procedure", "assay": "procedure", "theorem": "theory", "principle": "theory", "assumption": "theory", "baseline": "baseline", "reference": "baseline",
}
STOP_NAMES = (
    "this", "that", "these", "those", "we", "our", "the", "their", "approach", "method", "model", "architecture", "encoder", "decoder", "predictive", "joint-embedding", "framework",
    "system", "module", "for each environment", "test environments", "test environment",
)
STOP_TOKENS = ("a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "with", "module", "layer", "based", "type", "version")
NAME_STOP_TOKENS = ("the", "a", "an", "of", "for", "and", "or")
REQUIRED_CATEGORIES = ("objective", "procedure", "data", "evaluation")

# Patterns.
NAMED_ATOM = r"\b([A-Z][A-Za-z0-9-]{2,}(?:[ -][A-Z][A-Za-z0-9-]+){0,3})\s+(" + "|".join(SUFFIX_CATEGORY) + r")\b"
PARAMETER = (
    r"(?i)\b((?:[A-Za-z][A-Za-z-]{1,20}\s+){0,2}(?:learning rate|batch size|lattice size|step size|temperature|threshold|tolerance|cutoff|dropout|weight decay|decay|ratio|fraction|depth|width|pH|coefficient|rate|size))"
    r"\s*[:=]?\s*([0-9.eE\-]+)?"
)
ROLE_NEGATION = r"\b(?:not|no|without|fail(?:s|ed)?|cannot|refute[ds]?|unlike|contrary|differ(?:s|ed)?)\b"
INTENT_NEGATION = r"\b(?:not|no|without|fail(?:s|ed)?|cannot|refute[ds]?|unlike|contrary)\b"
DECIMAL = r"\b\d+\.\d+\b"
PLACEHOLDERS = (r"<\s*g\s*r\s*a\s*p\s*h\s*i\s*c\s*s\s*>", r"<\s*cit\.?\s*>", r"\\includegraphics\b[^\}]*\}", r"\\ref\{[^\}]+\}", r"\\eqref\{[^\}]+\}", r"\\label\{[^\}]+\}")
REFERENCE_ENTRY = r"^\s*\[\d{1,3}\]\s+\S"
EQUATION_BLOCK = r"(?s)\$\$.+?\$\$|\\begin\{(equation|align|gather)\*?\}"
GLOBAL_QUESTION = (
    r"(?i)\b(survey|overview|landscape|big picture|in general|across|compare (?:methods|approaches|papers|results|protocols)|state of the (?:art|field)|sota|main themes?|key papers?|"
    r"recent work|broadly|space of|what is the field)\b"
)
LOCAL_QUESTION = (
    r"(?i)(\b(?:what|which|how)\s+(?:is\s+the\s+)?(?:method|model|scheme|algorithm|architecture|objective|loss|function|criterion|dataset|benchmark|measurement|corpus|protocol|procedure|"
    r"optimizer|solver|integrator|scheduler|reaction(?:\s+conditions?)?|catalyst|reagent|conditions|parameter|hyperparameter|setting|temperature|threshold|coefficient|equation|formula|"
    r"theorem|principle|baseline|reference)\b)|(\bvalue of\b)|(\barxiv\b)|(\bs2:[a-f0-9]+\b)|(\bcite[ds]?\b)|(\bimplementation of\b)|(\barchitecture\s+of\b)|(\bwhat\s+is\s+the\s+\w+)"
)
# Classes of a prompt and of a phrase, first match wins.
PROMPT_CLASSES = (
    ("resume", r"(^|[^a-z])(continue|resume|pick\sup|where\s(was|were|are)\swe|last\ssession|yesterday|three\sdays\sago)"),
    ("compare", r"(?=.*(compare|differ|differs|versus|\svs\s)).*(arxiv|s2:|doi:|paper\s[ab]|both\spapers|two\spapers)"),
    ("port", r"(^|[^a-z])(port|adapt\sto|transfer\sto)(.|$)|use\s.*\sin\s(my|this|another|other)\s(repo|project|codebase)"),
    ("audit", r"(^|[^a-z])(audit|verify|review|reproduction)(.|$)|is\s(this|my|the).*(faithful|correct|right)|check.*against.*paper"),
    ("decision", r"(^|[^a-z])(tried|failed|gotcha)(.|$)|didn.t\swork|doesn.t\swork|(note|remember)\s(that|this)|for\sthe\srecord"),
)
IMPLEMENT = r"(^|[^a-z])(implement|reproduce|build\sthe|code\sup)(.|$)|port\sthe\s(method|loss|objective|architecture|encoder|decoder|integrator|protocol|reaction|scheme)"
IMPLEMENT_CLASSES = (
    ("implement-objective", r"loss|objective|reward|fitness|hamiltonian|action|yield"), ("implement-data", r"dataset|data\s|preprocess|measurement|sample|cohort|reads|tokeniz"),
    ("implement-procedure", r"optimizer|integrator|scheduler|solver|sampler|protocol|reaction\sconditions|training\sloop"), ("implement-evaluation", r"evaluat|metric|accuracy|f1|convergence\sdiagnostic|cross.?valid"),
    ("implement-baseline", r"baseline|prior\smethod|comparator|reference\smethod|control"),
)
DIVERGENCE = r"diverg|disagre|collaps|explod|nan\s|inf\s|doesn.t\smatch|don.t\smatch|wrong\sanswer|yield\sis\swrong|numbers\sdon.t\smatch"
PLAYBOOK_NAMES = {
    "method": "implement-method", "objective": "implement-objective", "data": "implement-data", "preprocessing": "implement-data", "procedure": "implement-procedure",
    "parameter": "implement-procedure", "evaluation": "implement-evaluation", "baseline": "implement-baseline", "theory": "implement-method", "debug": "debug-divergence",
    "debug-divergence": "debug-divergence", "divergence": "debug-divergence",
}
PLAYBOOK_CLASSES = (
    ("debug-divergence", r"diverg|disagre|collaps|explod|don.t\smatch|doesn.t\smatch"), ("implement-objective", r"loss|objective|reward|fitness|hamiltonian|action|yield|cost\sfunction"),
    ("implement-data", r"dataset|corpus|preprocess|tokeniz|measurement|sample|cohort|reads|specimen"),
    ("implement-procedure", r"optimizer|integrator|scheduler|solver|sampler|protocol|reaction\sconditions|training\sloop|step\ssize|time\sstep"),
    ("implement-evaluation", r"evaluat|metric|accuracy|f1|convergence\sdiagnostic|cross.?valid|spectra|chromatograph"), ("implement-baseline", r"baseline|prior\smethod|comparator|reference\smethod|control\sreaction"),
    ("implement-method", r"architecture|encoder|decoder|attention|scheme|algorithm|synthesis|protocol|module|layer|backbone|theorem|assumption|principle|invariant|conservation|bound"),
)
