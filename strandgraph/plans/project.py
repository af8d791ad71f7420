"""A small project whose texts stand here: what the operators on source code are shown on, as the driver has no such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INDEX = """import { fetchData, LIMIT as max } from './api';
import helper from './util/index';
import type { User } from './types';
export * from './util';

export async function main(id: number): Promise<User> {
  const user = await fetchData(id);
  if (id > max && helper(user)) {
    return user;
  }
  function inner(x) {
    return x ? main(x) : null;
  }
  return inner(id);
}
const unusedValue = eval('1');
"""
API = """import axios from 'axios';
import { gone } from './missing';
import { helper, absent } from './util';
export const LIMIT = 10;
const config = { url: 'x' };
function getConfig() { return config; }
export const fetchData = async (id: number, ...more: string[]) => {
  const token = process.env.TOKEN;
  for (const m of more) { helper(m); }
  return axios.get(getConfig().url + id + gone + token);
};
export class Client extends Base implements Api, Other {
  private size = 0;
  constructor(readonly name: string) { super(name); this.open(); }
  open(): void { this.size = LIMIT; }
}
"""
UTIL = """export { helper } from './helper';
export default function first(list) { return list[0]; }
"""
HELPER = """export function helper(x) { return isOk(x) || isOk(x.y); }
export function isOk(x) { try { return !!x; } catch (e) { return false; } }
export function lonely(a, b) { return a; }
export const lonely2 = 1, lonely3 = /a/;
export { lonely2 as lonely };
"""
TYPES = """export interface User extends Named, Aged { id: number; name?: string }
export type Id = string | number;
export enum Role { Admin, Guest = 2 }
import { main } from './index';
"""
CARD = """import { Row } from './Row';
function Local() { return <b>x</b>; }
export const Card = ({ title }) => (
  <Row onClick={() => go(title)} {...rest}>
    <Local size="1"><a>it's</a><img alt="i" /></Local>
    <Unknown size="2" color={title} /><button type="button">{title ? 'a' : 'b'}</button>
  </Row>
);
"""
COMPONENT = """<template>
  <div v-if="ok" @click="select" class="c">
    <slot name="head" /><slot />{{ title }}<Card v-for="c in cards" :key="c" @close="close" />
  </div>
</template>
<script setup lang="ts">
import Card from './Card.vue';
import { useRoute } from 'vue-router';
const props = withDefaults(defineProps<{ title: string; count?: number }>(), { count: 3 });
const emit = defineEmits<{ update: [value: string]; close: [] }>();
const route = useRoute();
const own = useOwn();
const select = () => { emit('update', props.title); };
function close() { emit('close'); }
defineExpose({ select, close });
</script>
<style scoped>.c { color: red }</style>
<i18n>{}</i18n>
"""
OPTIONS = """<template><p>{{ a }}</p></template>
<script>
import x from './x';
export default {
  props: { a: String, b: { type: Number, required: true, default: 1 } },
  emits: ['done'],
  expose: ['run'],
  methods: { run() { this.$emit('done'); } },
};
</script>
"""
BROKEN = "const a = { b: 'c;\n"
FILES = {
    "src/index.ts": INDEX, "src/api.ts": API, "src/util/index.ts": UTIL, "src/util/helper.js": HELPER, "src/types.ts": TYPES, "src/ui/Card.jsx": CARD,
    "src/ui/Panel.vue": COMPONENT, "src/ui/Old.vue": OPTIONS, "src/broken.js": BROKEN, "src/empty.js": "",
}


def files(spark: SparkSession) -> DataFrame:
    rows = [(path, f".{path.rsplit('.', 1)[-1]}", len(text.encode()), text.count("\n") + 1, text) for path, text in FILES.items()]
    return spark.createDataFrame(rows, "path string, ext string, size long, lines int, content string")


def literal(columns: str, rows: list[tuple]) -> str:
    """SQL that returns these rows: what a query over the texts above must give, checked by reading them."""

    def value(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + f") t({columns})"
