"""Fixed schemas of every input and model table; nothing is inferred."""

RAW_METADATA = "gmap_id string, name string, address string, url string, category array<string>"
RAW_REVIEWS = "user_id string, time bigint, rating int, gmap_id string"
RESTAURANTS = (
    "gmap_id string, name string, address string, url string, img_url string, Rating double, Reviews bigint"
)
REVIEWS = "user_id string, gmap_id string, rating int, time bigint"
USERS = "user_id string, ratings array<struct<rating:int,timestamp:bigint,gmap_id:string>>"
RECOMMENDATIONS = "user_id string, recommendations array<struct<gmap_id:string,score:double>>"
CLUSTERS = "cluster_id int, recommendations array<struct<gmap_id:string,score:double>>"
FEATURES = "gmap_id string"
CENTROIDS = "cluster_id int, gmap_id string, value double"
ASSIGNMENTS = "user_id string, cluster_id int"
EVENT = "event_type string, user_id string, gmap_id string, entering_time string, exiting_time string"
REVIEW_CHANGES = "op string, user_id string, gmap_id string, rating string, time bigint, seq bigint"
