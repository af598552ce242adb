"""Word lists. The public Snowball English stop words, and closed word classes."""

ENGLISH_STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing would should could ought i'm you're he's she's it's we're they're
i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't
wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't
mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very
""".split())

PRONOUNS = tuple("""
i me mine myself we us ours ourselves you yours yourself yourselves he him himself she hers herself it itself they
them theirs themselves who whom whoever what whatever someone somebody something anyone anybody anything everyone
everybody everything nobody nothing none one oneself
""".split())

DETERMINERS = tuple("""
a an the this that these those my your his her its our their some any no every each either neither all both another
which whose
""".split())

# Tokens are runs of letters and digits with an optional apostrophe part, or one other sign.
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:['’]\p{L}+)?|[^\s\p{L}\p{N}]"
NUMBER_PATTERN = r"^\p{N}+$"
SIGN_PATTERN = r"^[^\p{L}\p{N}]"

# Neighbours on a US keyboard; `v` is its own neighbour. Fixed values.
NEARBY_KEYS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "i": "ujko", "j": "huiknm", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "iklp0", "p": "ol", "q": "was", "r": "edft", "s": "wedxza", "t": "rfgy", "u": "yhji",
    "v": "cfgvb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx", "?": "/>.'", ".": ",/",
}
