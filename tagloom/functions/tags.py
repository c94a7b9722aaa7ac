"""Tables of HTML names."""

# Fixed values, all tables here: vocabularies and pairs of names that results depend on.

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SLASHED = frozenset("hr br img input".split())
RAW = frozenset(("script", "style"))
RCDATA = frozenset(("title", "textarea"))
FOREIGN = frozenset(("svg", "math"))
FORMAT_INLINE = frozenset("i b em small big sup sub q s strong summary".split())
INLINE = frozenset(
    "a abbr acronym b bdo big br button cite code dfn em i img input kbd label map object output q samp script select small span strong sub sup textarea time tt var".split()
)
BLOCK = frozenset(
    "address article aside blockquote canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav noscript ol p pre section table tfoot ul video".split()
)
STANDARD = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center
    cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter
    nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select
    slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u
    ul var video wbr""".split()
)

#: An open element of the key's name is closed by a start tag of one of these names.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "optgroup": {"optgroup", "hr"}, "option": {"option", "hr"},
    "colgroup": {"colgroup"}, "thead": {"tbody", "thead"}, "tbody": {"tbody", "tfoot"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
}

#: Under these parents' end tags, one open child of the key's name is closed (see tree.build, strict_end).
CLOSED_UNDER = {
    "option": {"select", "optgroup", "datalist"}, "li": {"ol", "ul", "menu"}, "dd": {"dl"}, "rt": {"ruby"}, "rp": {"ruby"}, "optgroup": {"select"},
    "tbody": {"table"}, "tfoot": {"table"}, "tr": {"table", "thead", "tbody"}, "td": {"tr"}, "th": {"tr"},
}

#: Attributes whose values compare without regard to case unless a selector says otherwise.
CASELESS = frozenset(
    """align bgcolor charset checked clear color defer dir disabled enctype frame hreflang http-equiv lang media method multiple readonly rel
    rules scope selected shape target type valign accept accept-charset alink axis codetype compact declare direction face language link
    nohref noresize noshade nowrap rev scrolling valuetype vlink""".split()
)

_SVG = """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer
feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur
feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef
linearGradient radialGradient textPath"""
_SVG_ATTRS = """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits definitionURL diffuseConstant edgeMode filterUnits glyphRef
gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight
markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX
pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions
requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage
tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"""
SVG_NAMES = {n.lower(): n for n in _SVG.split()}
SVG_ATTRIBUTES = {n.lower(): n for n in _SVG_ATTRS.split()}
