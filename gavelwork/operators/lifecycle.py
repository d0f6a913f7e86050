"""Replies, state changes and edits of notices as event folds."""

from pyspark.sql import functions as F

from gavelwork.functions.text import let, strip_all


def parse_reply(text):
    """``SI 14`` / ``NO 14`` to (respuesta, aviso_id); both NULL for any other message."""
    def pick(parts):
        ok = (F.size(parts) == 2) & F.get(parts, F.lit(0)).isin("SI", "NO")
        notice = F.when(ok, F.get(parts, F.lit(1)).try_cast("bigint"))
        return F.struct(F.when(notice.isNotNull(), F.when(F.get(parts, F.lit(0)) == "SI", "aprobado").otherwise("rechazado")).alias("respuesta"),
                        notice.alias("aviso_id"))

    return let(F.split(F.upper(strip_all(text)), r"\s+"), pick)


def apply_replies(replies, approvals):
    """Latest approval request of each notice with the reply applied to it."""
    from gavelwork.operators.matching import latest_per_key
    last = latest_per_key(approvals, ["aviso_id"], ["creado_en", "id"])
    r = latest_per_key(replies.select("aviso_id", "respuesta", F.col("ts").alias("respondido_en")), ["aviso_id"], ["respondido_en", "respuesta"])
    return last.join(r, "aviso_id", "left")


# fixed values: state set by each admin or approval event
EVENT_STATE = {"approve": "subido", "reject": "rechazado", "delete": "eliminado"}


def _state_map():
    return F.create_map(*[F.lit(x) for kv in EVENT_STATE.items() for x in kv])


def final_states(notices, events):
    """Latest state of each notice; restoring only works on a deleted notice and puts it back in the queue."""
    setting = F.col("evento").isin(list(EVENT_STATE))
    g = events.groupBy("aviso_id").agg(
        F.max_by(F.when(setting, F.col("evento")), F.when(setting, F.struct("ts", "id"))).alias("ultimo"),
        F.max(F.when(setting, F.struct("ts", "id"))).alias("cuando"), F.max(F.when(F.col("evento") == "restore", F.struct("ts", "id"))).alias("restaura"))
    j = notices.join(g, notices["id"] == g["aviso_id"], "left")
    gone = F.coalesce(F.col("ultimo"), F.when(F.col("estado") == "eliminado", "delete"))
    back = (gone == "delete") & F.col("restaura").isNotNull() & (F.col("cuando").isNull() | (F.col("restaura") > F.col("cuando")))
    state = F.when(back, "pendiente_procesar").otherwise(F.coalesce(F.try_element_at(_state_map(), F.col("ultimo")), F.col("estado")))
    return j.select(notices["id"], "estado", state.alias("estado_final"))


def audit_rows(events, bucket):
    """One audit row per event that took effect; a restore counts only right after a delete."""
    from gavelwork.operators.ordered import neighbour
    moves = events.filter(F.col("evento").isin([*EVENT_STATE, "restore"]))
    d = neighbour(moves, ["aviso_id"], ["ts", "id"], F.col("evento"), bucket, "previo")
    ok = d.filter((F.col("evento") != "restore") | (F.col("previo") == "delete"))
    action = F.element_at(F.create_map(*[F.lit(x) for kv in {"approve": "subida_tras_aprobacion", "reject": "rechazado", "delete": "eliminar_aviso",
                                                             "restore": "restaurar_aviso"}.items() for x in kv]), F.col("evento"))
    agent = F.when(F.col("evento") == "approve", "platform_upload").when(F.col("evento") == "reject", "whatsapp").otherwise("admin")
    moved = ok.select("aviso_id", "id", agent.alias("agente"), action.alias("accion"))
    applied = events.filter("evento = 'apply'").select("aviso_id", "id", F.lit("admin").alias("agente"), F.lit("aplicar_sugerencia").alias("accion"))
    return moved.unionByName(applied)


# fixed values: editable fields that do not teach anything
NOT_LEARNABLE = ["estado", "codigo", "categoria_codigo", "codigo_ubicacion", "fianza", "minimo"]


def edit_corrections(before, after, fields, documents):
    """Correction rows of an edit: learnable fields whose trimmed value changed to something."""
    def text(c):
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("None")), F.lit(""))

    def long(df, name):
        return df.select("id", *[text(f).alias(f) for f in fields]).unpivot("id", list(fields), "campo", name)

    j = long(before, "valor_anterior").join(long(after, "valor_nuevo"), ["id", "campo"])
    changed = j.filter((strip_all(F.col("valor_anterior")) != strip_all(F.col("valor_nuevo"))) & (strip_all(F.col("valor_nuevo")) != "")
                       & ~F.col("campo").isin(NOT_LEARNABLE))
    info = after.select("id", "pais", "documento_id")
    ctx = documents.select("documento_id", F.col("texto_ocr").alias("contexto"))
    out = changed.join(info, "id").join(ctx, "documento_id", "left")
    return out.withColumn("era_vacio", strip_all(F.col("valor_anterior")) == "")
