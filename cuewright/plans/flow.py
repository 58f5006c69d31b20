"""The modular flow: words to tagged cues, translation, fitting, slots. Each arrow is one DataFrame function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import segmentation as D
from ..operators import tables as U
from ..operators import timeline as W
from ..sources.scratch import stored


#: What the flow's fitting may say shorter, and leave out.
SHORTER = {"therefore": "so", "however": "but", "in order to": "to", "because of": "for", "a lot of": "many"}
FILLERS = ["really ", "actually ", "just ", "very "]


def run_full(v) -> DataFrame:
    words = J.glossary_tag_words(J.reconcile_words(v.words, v.words_alt, bucket_ms=10_000), v.glossary)
    cues = D.build_cues_dp(words).withColumnRenamed("cue_idx", "seg_idx")
    cues = J.glossary_tag_cues(Q.english_qc(cues), v.glossary)
    cues = U.translation_hints(cues).withColumn("text_translated", F.upper("text"))  # a stand-in for the caller's translator
    upper = {k.upper(): s.upper() for k, s in SHORTER.items()}
    fit = T.compress_if_needed(T.normalize_punct(F.col("text_translated")), F.col("end_ms") - F.col("start_ms"), upper, [f.upper() for f in FILLERS])
    cues = cues.withColumn("text_fit", fit)
    cues = J.glossary_validate(cues, v.glossary).withColumn("text_hi_display", T.format_lines(F.col("text_fit")))
    found = F.col("qc_flags")
    cues = Q.pre_tts_qc(cues.withColumn("_found", found), "text_fit").withColumn("qc_flags", F.concat("_found", "qc_flags")).drop("_found")
    cues = cues.withColumn("tts_ms", (T.count_words(F.col("text_fit")) * 450).cast("bigint"))
    cues = stored(cues, "flow-cues")  # what follows looks for large tracks first
    return W.recompute_slots(cues).withColumn("n_flags", F.size("qc_flags"))
