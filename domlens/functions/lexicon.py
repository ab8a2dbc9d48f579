"""Fixed values used by the lexical features.

Everything in this module is a FIXED VALUE: these lists and tables must equal
the originals for the features to come out the same, so they are stated
plainly, in their natural order (duplicates included), and never edited.
"""

# ---------------------------------------------------------------- fixed values: keywords
PHISHING_KEYWORDS = [
    "account", "action", "alert", "app", "auth", "bank", "billing", "center", "chat", "device", "fax", "event",
    "find", "free", "gift", "help", "info", "invoice", "live", "location", "login", "mail", "map", "message",
    "my", "new", "nitro", "now", "online", "pay", "promo", "real", "required", "safe", "secure", "security",
    "service", "signin", "support", "track", "update", "verification", "verify", "vm", "web",
]

BENIGN_KEYWORDS = [
    "blog", "book", "buy", "community", "design", "dev", "diary", "doc", "download", "edu", "family", "forum",
    "gallery", "game", "health", "home", "host", "lab", "learn", "media", "news", "photo", "play", "project",
    "research", "review", "school", "shop", "site", "store", "studio", "tech", "tutorial", "video", "wiki", "work",
    "safeframe", "googlesyndication", "silverhat", "fitcrack", "feta", "vut", "cesnet",
]

# ---------------------------------------------------------------- fixed values: suffix lists
TRUSTED_SUFFIXES = [
    "googlesyndication.com", "office.com", "fbcdn.net", "gstatic.com", "yahoodns.net",
    "fbcdn.net", "pinimg.com", "vut.cz", "vutbr.cz", "cvut.cz", "cuni.cz", "muni.cz", "cesnet.cz", "fitcrack.cz",
]

WELL_KNOWN_SUFFIXES = [
    "google.com", "facebook.com", "apple.com", "microsoft.com", "amazon.com",
    "twitter.com", "instagram.com", "linkedin.com", "adobe.com", "spotify.com",
    "netflix.com", "youtube.com", "pinterest.com", "whatsapp.com", "tiktok.com",
    "wikipedia.org", "mozilla.org", "wordpress.org", "bbc.co.uk", "nytimes.com",
    "reddit.com", "slack.com", "salesforce.com", "shopify.com", "dropbox.com",
    "samsung.com", "oracle.com", "ibm.com", "cisco.com", "zoom.us",
    "paypal.com", "mastercard.com", "visa.com", "stripe.com", "americanexpress.com",
    "tesla.com", "uber.com", "airbnb.com", "tripadvisor.com", "yelp.com",
    "nasa.gov", "cdc.gov", "who.int", "un.org", "europa.eu",
    "harvard.edu", "stanford.edu", "mit.edu", "cam.ac.uk", "github.com",
]

CDN_SUFFIXES = [
    "akamaihd.net", "akamai.net", "akamaiedge.net", "akamaitechnologies.com",
    "cloudfront.net", "edgecastcdn.net", "fastly.net", "stackpathcdn.com",
    "cachefly.net", "keycdn.com", "cloudflare.net", "maxcdn.com",
    "cdn77.org", "cdnify.io", "belugacdn.link", "kxcdn.com",
    "cdnetworks.net", "incapdns.net", "lswcdn.net", "llnw.net",
    "hwcdn.net", "nyucd.net", "onappcdn.com", "panthercdn.com",
    "simplecdn.net", "ssl.hwcdn.net", "rncdn1.com", "rlcdn.com",
    "rlcdn.com", "zenedge.net",
]

VPS_SUFFIXES = [
    "digitalocean.com", "linode.com", "vultr.com", "aws.amazon.com", "azure.com",
    "googleapis.com", "ovh.com", "hetzner.com", "bluehost.com", "hostgator.com",
    "godaddy.com", "dreamhost.com", "siteground.com", "a2hosting.com", "scaleway.com",
    "upcloud.com", "ramnode.com", "inmotionhosting.com", "liquidweb.com", "contabo.com",
    "cloud.google.com", "kamatera.com", "interserver.net", "lunanode.com", "buyvm.net",
    "time4vps.com", "vpsdime.com", "vpsserver.com", "hostwinds.com", "milesweb.com",
]

IMAGE_HOSTING_SUFFIXES = [
    "imgur.com", "flickr.com", "photobucket.com", "500px.com", "postimage.io", "tinypic.com",
    "deviantart.com", "imageshack.us", "imgbb.com", "imgsafe.org", "smugmug.com", "imagevenue.com",
    "imgbox.com", "imgpile.net", "pinterest.com", "pixabay.com", "unsplash.com", "pbase.com",
    "giphy.com", "gyazo.com", "directupload.net", "funkyimg.com", "imagebam.com", "cubeupload.com",
    "photo.net", "dropbox.com", "googleusercontent.com", "mediafire.com", "imgflip.com", "ifcdn.com",
    "img2share.com", "sli.mg", "imagefra.me", "yfrog.com", "cloudinary.com", "imgsrc.ru",
    "instagram.com", "snapfish.com", "shutterfly.com", "tumblr.com", "reddituploads.com", "vgy.me",
    "imageupper.com", "postimg.cc", "imgclick.net", "freeimagehosting.net", "imageupload.net",
    "image-share.com", "pic-upload.de", "imagehosting.com",
]

# Weights of the suffix score.
SUFFIX_SCORE_WEIGHTS = {"trusted": 10, "wellknown": 5, "cdn": 3, "vps": 2, "img": 8}

# ---------------------------------------------------------------- fixed values: TLD abuse scores
TLD_ABUSE_SCORES = {
    "com": 0.6554, "net": 0.1040, "eu": 0.0681, "name": 0.0651, "co": 0.0107, "life": 0.0087,
    "moe": 0.0081, "org": 0.0081, "xyz": 0.0072, "site": 0.0051, "ch": 0.0051, "it": 0.0048,
    "club": 0.0046, "info": 0.0043, "de": 0.0041, "racing": 0.0040, "live": 0.0035, "ru": 0.0034,
    "cc": 0.0034, "mobi": 0.0029, "me": 0.0023, "au": 0.0020, "cn": 0.0019, "pw": 0.0014,
    "in": 0.0011, "fr": 0.0010, "be": 0.0010, "pro": 0.0010, "top": 0.0009, "stream": 0.0007,
}

# ---------------------------------------------------------------- fixed values: character classes
VOWELS = "aeiouy"                      # compared after lower-casing
CONSONANTS = "bcdfghjklmnpqrstvwxyz"   # compared as is (not lower-cased)
HEX_CHARS = "0123456789ABCDEFabcdef"

# Dotted and dashed IPv4 address patterns (searched anywhere in the name).
IPV4_DOTTED = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_DASHED = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)-){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"

# Part-length buckets (inclusive bounds).
PART_BUCKETS = {"short": (None, 3), "medium": (4, 10), "long": (11, 30), "superlong": (31, None)}
